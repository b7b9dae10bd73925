"""Textures for flat mesh faces: grouping, texture size, texels, colours from nearby points."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.spatial import radius_join
from plumbline.session import spread


def face_groups(faces: DataFrame, near: float = 0.95) -> DataFrame:
    """(face, group) of faces (mesh, face, nx, ny, nz) in their order: a face starts a group if its normal differs from that of the group's first face. The order is part of the result, so a mesh is swept in one
    pass that holds the group's normal only; meshes are split over tasks."""

    def run(parts):
        here, group, n = None, -1, (0.0, 0.0, 0.0)
        for f in parts:
            out = []
            for mesh, x, y, z in zip(f.mesh, f.nx, f.ny, f.nz):
                if mesh != here or group < 0:
                    here, group, n = mesh, 0, (x, y, z)
                elif not n[0] * x + n[1] * y + n[2] * z >= near:
                    group, n = group + 1, (x, y, z)
                out.append(group)
            yield pd.DataFrame({"mesh": f.mesh, "face": f.face, "group": out})

    rows = spread(faces.select("mesh", F.col("face").cast("long").alias("face"), *(F.col(c).cast("double").alias(c) for c in ("nx", "ny", "nz"))), "mesh").sortWithinPartitions("mesh", "face")
    return rows.mapInPandas(run, f"mesh {dict(faces.dtypes)['mesh']}, face long, group int")


def texture_size(extent: float, per_metre: float = 400.0, least: int = 256, most: int = 4096) -> int:
    """The power of two nearest (in its exponent) to the extent in texels, within the bounds."""
    return max(least, min(most, 2 ** round(math.log2(max(extent * per_metre, 1e-9)))))


def texels(triangles: DataFrame, size: int, tolerance: float = -0.01) -> DataFrame:
    """(face, i, j, x, y, z) of texture cells whose centre lies in a triangle (face, u0, v0, ..., u2, v2 in 0..1 and x0..z2), by barycentric coordinates not below the tolerance. Only the cells of a
    triangle's bounding box are made."""
    cell = lambda c, f: F.least(F.lit(size - 1), F.greatest(F.lit(0), F.floor(f(*(F.col(f"{c}{k}") for k in range(3))) * size))).cast("int")
    t = triangles.withColumn("i", F.explode(F.sequence(cell("u", F.least), cell("u", F.greatest)))).withColumn("j", F.explode(F.sequence(cell("v", F.least), cell("v", F.greatest))))
    u, v = (F.col("i") + 0.5) / size, (F.col("j") + 0.5) / size
    det = (F.col("v1") - F.col("v2")) * (F.col("u0") - F.col("u2")) + (F.col("u2") - F.col("u1")) * (F.col("v0") - F.col("v2"))
    a = ((F.col("v1") - F.col("v2")) * (u - F.col("u2")) + (F.col("u2") - F.col("u1")) * (v - F.col("v2"))) / det
    b = ((F.col("v2") - F.col("v0")) * (u - F.col("u2")) + (F.col("u0") - F.col("u2")) * (v - F.col("v2"))) / det
    t = t.where(F.abs(det) > 1e-15).withColumns({"_a": a, "_b": b}).withColumn("_c", 1 - F.col("_a") - F.col("_b")).where((F.col("_a") >= tolerance) & (F.col("_b") >= tolerance) & (F.col("_c") >= tolerance))
    return t.select("face", "i", "j", *((F.col("_a") * F.col(f"{k}0") + F.col("_b") * F.col(f"{k}1") + F.col("_c") * F.col(f"{k}2")).alias(k) for k in "xyz"))


def texel_colours(cells: DataFrame, points: DataFrame, normals: DataFrame, radius: float = 0.04, most: int = 100, plane: float = 0.02, cos: float = 0.5) -> DataFrame:
    """(face, i, j, r, g, b, n): mean colour of the at most `most` nearest points (the operator's cap) within the radius, weighted by 1 / (distance^2 + 1e-6), of points near the face's plane whose
    normal agrees with the face's (normals: face, nx, ny, nz, d)."""
    c = cells.withColumn("point_idx", F.xxhash64("face", "i", "j"))
    q = c.join(normals.select("face", *(F.col(k).alias(f"f{k}") for k in ("nx", "ny", "nz", "d"))), "face")
    p = points.withColumns({f"p{a}": F.col(a).cast("double") for a in "xyz"}).withColumnsRenamed({"r": "red", "g": "green", "b": "blue"})
    j = radius_join(q, p, radius, ("face", "i", "j", "fnx", "fny", "fnz", "fd"), ("red", "green", "blue", "nx", "ny", "nz", "px", "py", "pz"))
    off = F.abs(sum(F.col(f"fn{a}") * F.col(f"p{a}") for a in "xyz") + F.col("fd"))
    j = j.where((off <= plane) & (sum(F.col(f"fn{a}") * F.col(f"n{a}") for a in "xyz") >= cos))
    j = j.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("d2", "b"))).where(F.col("k") <= most).withColumn("w", 1 / (F.col("d2") + 1e-6))
    mean = lambda col: F.round(F.sum(F.col(col) * F.col("w")) / F.sum("w")).cast("short")
    return j.groupBy("face", "i", "j").agg(mean("red").alias("r"), mean("green").alias("g"), mean("blue").alias("b"), F.count("*").alias("n"))
