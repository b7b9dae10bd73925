"""Joint refinement of sensor poses: points of neighbouring frames are matched, the pairs' normal equations are summed in Spark and the small system of all
poses is solved on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.geometry import se3_exp
from plumbline.session import stage

#: Most frames whose 6x6 blocks are solved together (a dense system of 6 times as many unknowns).
MOST_FRAMES = 2_000


def correspondences(surfels: DataFrame, pairs: DataFrame, poses: dict[int, np.ndarray], distance: float = 0.10, angle_deg: float = 45.0) -> DataFrame:
    """(a, b, pa..., pb..., nb...) in world coordinates: for each pair of frames (a, b) and each point of a the nearest point of b within the distance, if their normals agree. Surfels
    are (node_id, point_idx, x, y, z, nx, ny, nz) in their frame. Nearest on a grid with cells as wide as the distance."""
    spark = surfels.sparkSession
    rows = [(int(k), [float(x) for x in m.ravel()]) for k, m in poses.items()]
    s = surfels.join(F.broadcast(spark.createDataFrame(rows, "node_id long, m array<double>")), "node_id")  # at most MOST_FRAMES matrices
    m = lambda i: F.col("m")[i]
    turn = lambda v, r: m(4 * r) * F.col(f"{v}x") + m(4 * r + 1) * F.col(f"{v}y") + m(4 * r + 2) * F.col(f"{v}z")
    w = stage(s.select("node_id", "point_idx", *((turn("", r) + m(4 * r + 3)).alias(a) for r, a in enumerate("xyz")), *(turn("n", r).alias(f"n{a}") for r, a in enumerate("xyz"))))
    cell = lambda a: F.floor(F.col(a) / distance).cast("long")
    a = w.join(pairs, w.node_id == pairs.a).select("a", "b", "point_idx", *(F.col(c).alias(f"p{c}") for c in ("x", "y", "z")), *(F.col(f"n{c}").alias(f"m{c}") for c in "xyz"), *(cell(c).alias(f"c{c}") for c in "xyz"))
    for c in "xyz":
        a = a.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_d")).drop("_d")
    b = w.select(F.col("node_id").alias("b"), F.col("point_idx").alias("target"), *(F.col(c).alias(f"q{c}") for c in "xyz"), *(F.col(f"n{c}") for c in "xyz"), *(cell(c).alias(f"c{c}") for c in "xyz"))
    d2 = sum((F.col(f"p{c}") - F.col(f"q{c}")) ** 2 for c in "xyz")
    j = a.join(b, ["b", "cx", "cy", "cz"]).withColumn("d2", d2).where(F.col("d2") <= distance * distance)
    near = F.struct("d2", "target", *(f"q{c}" for c in "xyz"), *(f"n{c}" for c in "xyz"), *(f"m{c}" for c in "xyz"), *(f"p{c}" for c in "xyz"))
    best = j.groupBy("a", "b", "point_idx").agg(F.min(near).alias("t")).select("a", "b", "point_idx", "t.*")
    return best.where(sum(F.col(f"n{c}") * F.col(f"m{c}") for c in "xyz") >= float(np.cos(np.radians(angle_deg))))


def normal_equations(matches: DataFrame, scale: float = 0.05, kernel: str = "welsch") -> DataFrame:
    """(a, b, h, g, energy, n) per pair: the 12x12 Gauss-Newton block (row-major), its right side and the robust energy of point-to-plane residuals, for left-multiplied twists of a and b.
    Blocks are summed per Arrow batch and then per pair."""

    def run(parts):
        for f in parts:
            out = []
            for (a, b), g in f.groupby(["a", "b"]):
                p, q, n = (g[[f"{k}x", f"{k}y", f"{k}z"]].to_numpy(float) for k in "pqn")
                r = ((p - q) * n).sum(axis=1)
                w = np.exp(-0.5 * (r / scale) ** 2) if kernel == "welsch" else np.where(np.abs(r) <= scale, 1.0, scale / np.maximum(np.abs(r), 1e-12))
                ja = np.hstack([n, np.cross(p, n)])
                jb = -np.hstack([n, np.cross(q, n)])
                j = np.hstack([ja, jb])
                energy = scale**2 * (1 - np.exp(-0.5 * (r / scale) ** 2)) if kernel == "welsch" else np.where(np.abs(r) <= scale, r * r / 2, scale * (np.abs(r) - scale / 2))
                out.append((a, b, ((j * w[:, None]).T @ j).ravel().tolist(), ((j * w[:, None]).T @ r).tolist(), float(energy.sum()), len(r), float((r * r).sum())))
            yield pd.DataFrame(out, columns=["a", "b", "h", "g", "energy", "n", "rr"])

    part = matches.mapInPandas(run, "a long, b long, h array<double>, g array<double>, energy double, n long, rr double")
    add = lambda c, k: F.array(*(F.sum(F.col(c)[i]) for i in range(k))).alias(c)
    return part.groupBy("a", "b").agg(add("h", 144), add("g", 12), F.sum("energy").alias("energy"), F.sum("n").alias("n"), F.sum("rr").alias("rr"))


def refine(surfels: DataFrame, pairs: DataFrame, poses: dict[int, np.ndarray], rounds: int = 10, tries: int = 10, prior: float = 1e-6, **matching: float) -> tuple[dict[int, np.ndarray], list[float]]:
    """Refined poses and the energies accepted. The first frame is the anchor and stays. Levenberg-Marquardt: a step is taken only if the energy of the new matches drops; else the
    damping grows, up to `tries` times. ValueError for fewer than two frames or too many for one system."""
    ids = sorted(poses)
    if len(ids) < 2:
        raise ValueError("two frames are needed")
    if len(ids) > MOST_FRAMES:
        raise ValueError(f"more than {MOST_FRAMES} frames; refine them in overlapping parts")
    at = {k: i for i, k in enumerate(ids)}
    pairs = stage(pairs.select("a", "b").distinct())

    def linear(p):
        rows = normal_equations(correspondences(surfels, pairs, p, **matching)).collect()  # one 12x12 block per pair of a bounded number of frames
        h, g = np.eye(6 * len(ids)) * prior, np.zeros(6 * len(ids))
        for r in rows:
            block, right = np.array(r["h"]).reshape(12, 12), np.array(r["g"])
            s = np.r_[6 * at[r["a"]] : 6 * at[r["a"]] + 6, 6 * at[r["b"]] : 6 * at[r["b"]] + 6]
            h[np.ix_(s, s)] += block
            g[s] += right
        n = sum(r["n"] for r in rows)
        return h[6:, 6:], g[6:], sum(r["energy"] for r in rows) / max(n, 1), n

    h, g, energy, n = linear(poses)
    trace, damping = [energy], 1e-4
    for _ in range(rounds):
        for _ in range(tries):
            step = np.linalg.solve(h + damping * np.diag(np.maximum(np.diag(h), 1e-9)), -g)
            new = {k: (poses[k] if i == 0 else se3_exp(step[6 * (i - 1) : 6 * i]) @ poses[k]) for k, i in at.items()}
            h2, g2, e2, n2 = linear(new)
            if n2 and e2 < energy:
                done = energy - e2 < 1e-9 * max(energy, 1e-12)
                poses, h, g, energy, damping = new, h2, g2, e2, damping / 10
                trace.append(energy)
                break
            damping *= 10
        else:
            return poses, trace
        if done:
            return poses, trace
    return poses, trace


def rms(residuals: DataFrame, column: str = "r") -> DataFrame:
    """(rms) of a column, 0 for no rows."""
    return residuals.agg(F.coalesce(F.sqrt(F.avg(F.col(column) * F.col(column))), F.lit(0.0)).alias("rms"))
