"""Row-wise geometry as columns, and the plane operators that walk over a building's few planes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows
from plumbline.operators.voxel import AXES, finite


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def back_project(pixels: DataFrame, least: float = 0.0, most: float = float("inf"), confidence: int = 0, step: int = 1) -> DataFrame:
    """Camera coordinates (x, y, z) of depth pixels (u, v, z in metres, conf, fx, fy, cx, cy): those on the sampling grid with a positive
    depth in range and enough confidence."""
    ok = (F.col("z") > 0) & (F.col("z") >= least) & (F.col("z") <= most) & ~F.isnan("z") & (F.col("conf") >= confidence) & (F.col("u") % step == 0) & (F.col("v") % step == 0)
    p = pixels.where(ok)
    return p.withColumn("x", (F.col("u") - F.col("cx")) * F.col("z") / F.col("fx")).withColumn("y", (F.col("v") - F.col("cy")) * F.col("z") / F.col("fy"))


def scale_intrinsics(frame: DataFrame, width: str, height: str) -> DataFrame:
    """Intrinsics of (fx, fy, cx, cy, width, height) for an image of another size."""
    sx, sy = F.col(width) / F.col("width"), F.col(height) / F.col("height")
    return frame.withColumns({"fx": F.col("fx") * sx, "fy": F.col("fy") * sy, "cx": F.col("cx") * sx, "cy": F.col("cy") * sy})


def rigid(points: DataFrame, pose: list[float] | Column) -> DataFrame:
    """Points moved by a row-major 4x4 matrix, a literal or an array column."""
    m = (lambda i: F.lit(float(pose[i]))) if isinstance(pose, list) else (lambda i: pose[i])
    new = {a: m(4 * r) * F.col("x") + m(4 * r + 1) * F.col("y") + m(4 * r + 2) * F.col("z") + m(4 * r + 3) for r, a in enumerate(AXES)}
    return points.withColumns(new)


def plane_distance(a="a", b="b", c="c", d="d") -> Column:
    """Signed distance of (x, y, z) to the plane, divided by the squared length of its normal (equal for unit normals)."""
    a, b, c, d = map(_c, (a, b, c, d))
    return (a * F.col("x") + b * F.col("y") + c * F.col("z") + d) / (a * a + b * b + c * c)


def plane_class(eps: float = 0.1, c: str | Column = "c") -> Column:
    """vertical (normal lies level), horizontal (normal points up or down) or tilted."""
    up = F.abs(_c(c))
    return F.when(up < eps, "vertical").when(F.abs(up - 1) < eps, "horizontal").otherwise("tilted")


def force_orthogonal(planes: DataFrame, eps: float = 0.1) -> DataFrame:
    """Planes (a, b, c, d, x, y, z with a centroid): walls lose the upright part of their normal, floors and ceilings all but it; tilted ones
    stay. d is set anew so that the centroid stays on the plane."""
    kind = plane_class(eps)
    level = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2)
    n = {
        "a": F.when(kind == "vertical", F.col("a") / level).when(kind == "horizontal", 0.0).otherwise(F.col("a")),
        "b": F.when(kind == "vertical", F.col("b") / level).when(kind == "horizontal", 0.0).otherwise(F.col("b")),
        "c": F.when(kind == "vertical", 0.0).when(kind == "horizontal", F.signum("c")).otherwise(F.col("c")),
    }
    out = planes.withColumns({f"_{k}": v for k, v in n.items()}).drop("a", "b", "c").withColumnsRenamed({"_a": "a", "_b": "b", "_c": "c"})
    return out.withColumn("d", -(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z")))


def planes_of(points: DataFrame, normals: DataFrame) -> DataFrame:
    """(plane_id, a, b, c, d, x, y, z, n) from labelled points (point_idx, label, x, y, z; label 0 is none) and one normal per rank of label
    (rank from 0, a, b, c): d = -n.c."""
    g = points.where("label > 0").groupBy("label").agg(*(F.avg(F.col(a).cast("double")).alias(a) for a in AXES), F.count("*").alias("n"))
    g = number_rows(g, "label", name="rank", start=0)
    j = g.join(normals, "rank")
    return j.select(F.col("label").alias("plane_id"), "a", "b", "c", (-(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z"))).alias("d"), *AXES, "n")


def polygon_measures(corners: DataFrame) -> DataFrame:
    """(polygon, n, nx, ny, nz, area, x, y, z, valid) of ordered corners (polygon, k, x, y, z): Newell normal, area, mean corner; area 0 and not valid
    below three corners."""
    w = Window.partitionBy("polygon").orderBy("k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = corners.select("polygon", *AXES, *(F.coalesce(F.lead(a).over(w), F.first(a).over(whole)).alias(f"q{a}") for a in AXES))
    cross = {"x": "y*qz - z*qy", "y": "z*qx - x*qz", "z": "x*qy - y*qx"}
    g = c.groupBy("polygon").agg(F.count("*").alias("n"), *(F.sum(F.expr(e)).alias(f"s{a}") for a, e in cross.items()), *(F.avg(a).alias(a) for a in AXES))
    size = F.sqrt(sum(F.col(f"s{a}") ** 2 for a in AXES))
    ok = (F.col("n") >= 3) & (size > 1e-12)
    return g.select("polygon", "n", *(F.when(ok, F.col(f"s{a}") / size).otherwise(0.0).alias(f"n{a}") for a in AXES), F.when(F.col("n") >= 3, size / 2).otherwise(0.0).alias("area"), *AXES, ok.alias("valid"))


def inside_polygon(u: Column, v: Column, ring: Column) -> Column:
    """Whether (u, v) lies in a polygon given as an array of structs (u, v), by the winding number; all in codegen."""
    at = lambda i: F.element_at(ring, (i % F.size(ring)) + 1)

    def turn(i):
        p, q = at(i), at(i + 1)
        left = (q["u"] - p["u"]) * (v - p["v"]) - (u - p["u"]) * (q["v"] - p["v"])
        return F.when((p["v"] <= v) & (q["v"] > v) & (left > 0), 1).when((p["v"] > v) & (q["v"] <= v) & (left < 0), -1).otherwise(0)

    return (F.size(ring) >= 3) & (F.aggregate(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), turn), F.lit(0), lambda a, b: a + b) != 0)


def segment_distance(u: Column, v: Column, ring: Column) -> Column:
    """Distance of (u, v) to the nearest edge of a polygon."""
    at = lambda i: F.element_at(ring, (i % F.size(ring)) + 1)

    def edge(i):
        p, q = at(i), at(i + 1)
        du, dv = q["u"] - p["u"], q["v"] - p["v"]
        n = du * du + dv * dv
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((u - p["u"]) * du + (v - p["v"]) * dv) / n))).otherwise(0.0)
        return F.sqrt((p["u"] + t * du - u) ** 2 + (p["v"] + t * dv - v) ** 2)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), edge))


def wall_distance(u: Column, v: Column, w: Column, ring: Column) -> Column:
    """Distance of a point in a wall's frame (u, v in the wall, w off it) to the wall: off the plane inside the outline, else to its edge."""
    return F.when(inside_polygon(u, v, ring), F.abs(w)).otherwise(F.sqrt(w * w + segment_distance(u, v, ring) ** 2))


def region_means(faces: DataFrame) -> DataFrame:
    """(region, nx, ny, nz, x, y, z, area): area-weighted normal (unit) and centre of the faces (region, nx, ny, nz, x, y, z, area) of each region."""
    g = faces.groupBy("region").agg(*(F.sum(F.col(c) * F.col("area")).alias(c) for c in ("nx", "ny", "nz", *AXES)), F.sum("area").alias("area"))
    size = F.sqrt(sum(F.col(f"n{a}") ** 2 for a in AXES))
    return g.select("region", *(F.when(size > 0, F.col(f"n{a}") / size).otherwise(0.0).alias(f"n{a}") for a in AXES), *((F.col(a) / F.col("area")).alias(a) for a in AXES), "area")


def bounds(points: DataFrame, *by: str) -> DataFrame:
    """Bounding box of the finite points, per group or in all."""
    return points.where(finite(*AXES)).groupBy(*by).agg(*(f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n"))


# ---- a building's planes: some hundreds of rows, whose greedy order is part of the result; Python lists of dicts


def fit_plane(points: np.ndarray) -> tuple[np.ndarray, float]:
    centre = points.mean(axis=0)
    normal = np.linalg.svd(points - centre, full_matrices=False)[2][2]
    return normal, float(-normal @ centre)


def merge_planes(planes: list[dict], angle: float = 0.1, overlap: float = 0.8, threshold: float = 0.5) -> list[dict]:
    """Greedily, in order: a plane {n, d, points} joins the first one met whose normal agrees (|n.n - 1| <= angle) and whose points lie on it, and
    its on the other, for a share of at least `overlap` of both; the plane is then fitted anew."""
    out: list[dict] = []
    for p in planes:
        for q in out:
            if abs(p["n"] @ q["n"] - 1) > angle:
                continue
            on = sum(int((np.abs(a["points"] @ b["n"] + b["d"]) < threshold).sum()) for a, b in ((p, q), (q, p)))
            if on / (len(p["points"]) + len(q["points"])) >= overlap:
                q["points"] = np.vstack([q["points"], p["points"]])
                n, d = fit_plane(q["points"])
                q["n"], q["d"] = (n, d) if n @ q["n"] >= 0 else (-n, -d)
                break
        else:
            out.append(dict(p))
    return out


def pair_planes(planes: list[dict], distance: float = 0.6, offset: float = 0.25, tolerance: float = 0.1) -> list[tuple[dict, dict]]:
    """Pairs of planes {n, d, c} that face away from each other and are nearest, greedily in order; a plane without partner gets a twin at the offset
    behind it."""
    left, out = list(range(len(planes))), []
    while left:
        i = left.pop(0)
        p = planes[i]
        cost = {}
        for j in left:
            q = planes[j]
            if abs(p["n"] @ q["n"] + 1) <= tolerance:
                gap = (abs(p["n"] @ q["c"] + p["d"]) + abs(q["n"] @ p["c"] + q["d"])) / 2
                if gap < distance:
                    cost[j] = gap
        if cost:
            j = min(cost, key=lambda k: (cost[k], k))
            left.remove(j)
            out.append((p, planes[j]))
        else:
            c = p["c"] - p["n"] * offset
            out.append((p, {"n": -p["n"], "c": c, "d": float(p["n"] @ c), "synthetic": True}))
    return out


def regularise(normals: np.ndarray, degrees: float = 10.0) -> np.ndarray:
    """Normals within the angle of an axis, or of one met before (also turned round or at a right angle in plan), are set to it."""
    out: list[np.ndarray] = []
    near = math.cos(math.radians(degrees))
    for n in normals / np.linalg.norm(normals, axis=1, keepdims=True):
        known = [np.array([0, 0, 1.0])]
        for o in out:
            known += [o, np.array([-o[1], o[0], 0.0])] if abs(o[2]) < 1e-9 else [o]
        hit = next((k for k in known if abs(n @ k) >= near), n)
        out.append(hit if n @ hit >= 0 else -hit)
    return np.array(out)


# ---- rigid motions


def se3_exp(x: np.ndarray) -> np.ndarray:
    """The 4x4 motion of a twist (translation part first, then rotation)."""
    v, w = x[:3], x[3:]
    t = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    a, b, c = (1 - t * t / 6, 0.5 - t * t / 24, 1 / 6 - t * t / 120) if t < 1e-6 else (math.sin(t) / t, (1 - math.cos(t)) / t**2, (t - math.sin(t)) / t**3)
    out = np.eye(4)
    out[:3, :3] = np.eye(3) + a * k + b * k @ k
    out[:3, 3] = (np.eye(3) + b * k + c * k @ k) @ v
    return out


def se3_log(m: np.ndarray) -> np.ndarray:
    """The twist of a 4x4 motion."""
    r = m[:3, :3]
    t = math.acos(max(-1.0, min(1.0, (np.trace(r) - 1) / 2)))
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    if t < 1e-6:
        w = axis / 2
    elif math.pi - t < 1e-4:
        values, vectors = np.linalg.eigh((r + r.T) / 2)
        n = vectors[:, -1]
        w = t * (n if n @ axis >= 0 else -n)
    else:
        w = axis * t / (2 * math.sin(t))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    e = 1 / 12 if t < 1e-4 else 1 / t**2 - (1 + math.cos(t)) / (2 * t * math.sin(t)) if math.pi - t > 1e-4 else 1 / t**2
    return np.concatenate([(np.eye(3) - k / 2 + e * k @ k) @ m[:3, 3], w])
