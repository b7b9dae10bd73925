"""Planar segmentation of points with normals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows
from plumbline.operators.components import components
from plumbline.operators.spatial import radius_join
from plumbline.session import stage


def grow_regions(points: DataFrame, angle_deg: float = 25.0, distance: float = 0.07, least: int = 1000, radius: float = 0.5, refit: int = 16, factor: float = 1.5, by: str = "cloud") -> DataFrame:
    """(by, point_idx, plane) of points (by, point_idx, x, y, z, nx, ny, nz, curvature), grown from seeds in order of curvature; 0 for none, planes from 1.

    A region takes the unlabelled neighbours whose normal agrees with the region's and that lie on its plane, and fits the plane anew at growing sizes.
    The result depends on the order, so one cloud is one group and is grown in one task; clouds are split over tasks. For a cloud
    that doesn't fit a task use `coplanar_components`."""
    near = math.cos(math.radians(angle_deg))

    def grow(f: pd.DataFrame) -> pd.DataFrame:
        p, n = f[["x", "y", "z"]].to_numpy(float), f[["nx", "ny", "nz"]].to_numpy(float)
        label = np.zeros(len(f), np.int64)
        cells: dict[tuple, list[int]] = {}
        grid = np.floor(np.where(np.isfinite(p), p, 0) / radius).astype(np.int64)
        ok = np.isfinite(p).all(axis=1) & np.isfinite(n).all(axis=1)
        for i in np.flatnonzero(ok):
            cells.setdefault(tuple(grid[i]), []).append(i)
        shifts = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]

        def around(i: int) -> np.ndarray:
            x, y, z = grid[i]
            j = np.array([k for a, b, c in shifts for k in cells.get((x + a, y + b, z + c), ())])
            return j[((p[j] - p[i]) ** 2).sum(axis=1) <= radius * radius]

        used = ~ok
        regions = []
        for seed in np.lexsort((f.point_idx.to_numpy(), f.curvature.to_numpy())):
            if used[seed]:
                continue
            used[seed] = True
            members, queue = [seed], [seed]
            normal, offset, next_fit = n[seed], float(n[seed] @ p[seed]), refit
            while queue:
                j = around(queue.pop(0))
                j = j[~used[j]]
                j = j[(np.abs(n[j] @ normal) >= near) & (np.abs(p[j] @ normal - offset) <= distance)]
                used[j] = True
                members += j.tolist()
                queue += j.tolist()
                if len(members) >= next_fit:
                    q = p[members]
                    centre = q.mean(axis=0)
                    fitted = np.linalg.eigh(np.cov((q - centre).T))[1][:, 0]
                    normal = fitted if fitted @ normal >= 0 else -fitted
                    offset, next_fit = float(normal @ centre), int(next_fit * factor) + 1
            if len(members) >= least:
                regions.append(members)
            else:
                used[members] = True
        for k, m in enumerate(regions, 1):
            label[m] = k
        return pd.DataFrame({by: f[by], "point_idx": f.point_idx, "plane": label})

    kind = dict(points.dtypes)[by]
    return points.groupBy(by).applyInPandas(grow, f"{by} {kind}, point_idx long, plane long")


def coplanar_components(points: DataFrame, angle_deg: float = 25.0, distance: float = 0.07, least: int = 1000, radius: float = 0.5) -> DataFrame:
    """(point_idx, plane): connected components of neighbours with agreeing normals that lie on each other's plane. The scalable stand-in for growing: no order, so no
    refit on the way, and gently curved surfaces stay in one piece."""
    near = math.cos(math.radians(angle_deg))
    other = points.select("point_idx", "x", "y", "z", *(F.col(f"n{a}").alias(f"m{a}") for a in "xyz"), *(F.col(a).alias(f"q{a}") for a in "xyz"))
    mine = points.select("point_idx", "x", "y", "z", "nx", "ny", "nz", *(F.col(a).alias(f"p{a}") for a in "xyz"))
    j = radius_join(mine, other, radius, ("nx", "ny", "nz", "px", "py", "pz"), ("mx", "my", "mz", "qx", "qy", "qz")).where("a < b")
    dot = F.abs(sum(F.col(f"n{a}") * F.col(f"m{a}") for a in "xyz"))
    off = lambda n: F.abs(sum((F.col(f"q{a}") - F.col(f"p{a}")) * F.col(f"{n}{a}") for a in "xyz"))
    c = stage(components(j.where((dot >= near) & (off("n") <= distance) & (off("m") <= distance)).select("a", "b")))
    big = c.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    got = c.join(number_rows(big, F.desc("n"), "component", name="plane").select("component", "plane"), "component").select(F.col("node").alias("point_idx"), "plane")
    return points.select("point_idx").join(got, "point_idx", "left").select("point_idx", F.coalesce("plane", F.lit(0)).cast("long").alias("plane"))


def refit_planes(points: DataFrame) -> DataFrame:
    """(plane, n, a, b, c, d, x, y, z) by least squares over labelled points (plane, x, y, z; 0 is none). Nine sums per plane in Spark; the eigenproblems of the planes
    in numpy."""
    pairs = [(u, v) for i, u in enumerate("xyz") for v in "xyz"[i:]]
    g = points.where("plane > 0").groupBy("plane").agg(F.count("*").alias("n"), *(F.avg(u).alias(u) for u in "xyz"), *(F.covar_pop(u, v).alias(u + v) for u, v in pairs))

    def solve(parts):
        for f in parts:
            m = np.array([[f[min(u, v) + max(u, v)] for v in "xyz"] for u in "xyz"], float).transpose(2, 0, 1) if len(f) else np.zeros((0, 3, 3))
            n = np.linalg.eigh(m)[1][:, :, 0]
            k = np.abs(n).argmax(axis=1)
            n *= np.sign(n[np.arange(len(n)), k])[:, None]  # the largest component is positive
            d = -(n * f[["x", "y", "z"]].to_numpy()).sum(axis=1)
            yield pd.DataFrame({"plane": f.plane, "n": f.n, "a": n[:, 0], "b": n[:, 1], "c": n[:, 2], "d": d, "x": f.x, "y": f.y, "z": f.z})

    return g.mapInPandas(solve, "plane long, n long, a double, b double, c double, d double, x double, y double, z double")
