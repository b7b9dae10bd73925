"""Operators that group the points of a cloud: voxels, samples, clips, strides, camera groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows

AXES = ("x", "y", "z")
#: Most voxels along an axis, and in all.
MOST_CELLS, MOST_VOXELS = (1 << 21) - 1, (1 << 32) - 1


def finite(*names: str) -> Column:
    """All of them are numbers: neither null, NaN nor infinite (Spark's NaN equals itself and exceeds everything)."""
    out = F.lit(True)
    for n in names:
        c = F.col(n).cast("double")
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def voxel_cells(points: DataFrame, leaf: float) -> DataFrame:
    """`points` that are finite, with the voxel (ix, iy, iz) each lies in, counted from the corner of the bounding box.
    ValueError for a leaf that isn't positive, no finite point, or a box with too many voxels along an axis."""
    if not leaf > 0:
        raise ValueError("a voxel needs a positive size")
    good = points.where(finite(*AXES))
    box = good.agg(*(f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if box["lo_x"] is None:
        raise ValueError("no point is finite")
    if any((box[f"hi_{a}"] - box[f"lo_{a}"]) / leaf > MOST_CELLS for a in AXES):
        raise ValueError("the cloud is too wide for voxels of that size")
    return good.withColumns({f"i{a}": F.floor((F.col(a).cast("double") - F.lit(box[f"lo_{a}"])) * F.lit(1.0 / leaf)).cast("long") for a in AXES})


def voxel_assign(points: DataFrame, leaf: float) -> DataFrame:
    """(point_idx, bucket): buckets are numbered from 0 by their first point."""
    cells = voxel_cells(points, leaf)
    key = ["ix", "iy", "iz"]
    buckets = number_rows(cells.groupBy(*key).agg(F.min("point_idx").alias("first")), "first", name="bucket", start=0)
    return cells.join(buckets, key).select("point_idx", "bucket")


def voxel_centroid(points: DataFrame, leaf: float, colours: tuple[str, ...] = ()) -> DataFrame:
    """(ix, iy, iz, n, first, x, y, z, colours...): mean position in double, mean colours rounded half away from zero."""
    return voxel_cells(points, leaf).groupBy("ix", "iy", "iz").agg(
        F.count("*").alias("n"), F.min("point_idx").alias("first"), *(F.avg(F.col(a).cast("double")).alias(a) for a in AXES), *(F.round(F.avg(c)).cast("short").alias(c) for c in colours))


def voxel_normals(normals: DataFrame, assignment: DataFrame) -> DataFrame:
    """(bucket, nx, ny, nz, curvature): mean of the finite normals of each bucket, to unit length where it has one; curvature
    over the same divisor. A bucket without finite normals stays, with NaN normals and curvature 0."""
    names = ("nx", "ny", "nz")
    ok = finite(*names)
    value = lambda c: F.sum(F.when(ok, F.col(c).cast("double")))
    g = assignment.join(normals, "point_idx", "left").groupBy("bucket").agg(
        F.count_if(ok).alias("n"), *(value(c).alias(c) for c in names), F.sum(F.when(ok & finite("curvature"), F.col("curvature").cast("double"))).alias("c"))
    mean = {c: F.col(c) / F.col("n") for c in names}
    size = F.sqrt(sum(m * m for m in mean.values()))
    return g.select("bucket", *(F.when(F.col("n") == 0, float("nan")).when(size > 1e-12, m / size).otherwise(m).alias(c) for c, m in mean.items()),
                    F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce(F.col("c") / F.col("n"), F.lit(0.0))).alias("curvature"))


def uniform_sample(points: DataFrame, cell: float, by: str = "label") -> DataFrame:
    """Per label and grid cell the point nearest to the cell's centre (the first of equally near ones)."""
    c = points.where(finite(*AXES)).withColumns({f"i{a}": F.floor(F.col(a).cast("double") / F.lit(cell)).cast("long") for a in AXES})
    d2 = sum((F.col(a).cast("double") - (F.col(f"i{a}") + 0.5) * F.lit(cell)) ** 2 for a in AXES)
    row = F.struct(d2.alias("d2"), "point_idx", *AXES)
    g = c.groupBy(by, "ix", "iy", "iz").agg(F.min(row).alias("r"))
    return g.select(by, "ix", "iy", "iz", "r.point_idx", *(F.col(f"r.{a}") for a in AXES))


def percentile_box(seeds: DataFrame, lo: float = 0.01, hi: float = 0.99, margin: float = 0.0, least: int = 100) -> dict[str, tuple[float, float]] | None:
    """Per axis the values at positions floor(p (n - 1)) of the finite seeds in order, widened by margin times the span; None
    if there are no more than `least` seeds. Only two values an axis reach the driver."""
    good = seeds.where(finite(*AXES))
    n = good.count()
    if n <= least:
        return None
    out = {}
    for a in AXES:
        at = [int(p * (n - 1)) for p in (lo, hi)]
        v = {r["rn"]: float(r[a]) for r in number_rows(good.select(F.col(a).cast("double").alias(a)), a, start=0).where(F.col("rn").isin(at)).collect()}
        low, high = v[at[0]], v[at[1]]
        out[a] = (low - margin * (high - low), high + margin * (high - low))
    return out


def percentile_clip(points: DataFrame, seeds: DataFrame, **how: float) -> DataFrame:
    """The points within `percentile_box` of the seeds; all of them if there is no box."""
    box = percentile_box(seeds, **how)
    return points if box is None else points.where(" and ".join(f"{a} between {lo!r}D and {hi!r}D" for a, (lo, hi) in box.items()))


def stride_sample(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """Every k-th row in the given order, k so that at most `most` are left (this operator's purpose)."""
    n = rows.count()
    step = max(1, -(-n // most))
    return number_rows(rows, *order, start=0).where(F.col("rn") % step == 0).drop("rn")


def chunk_frames(frames: DataFrame, size: int, order: str = "node_id") -> DataFrame:
    """`frames` with the number of the chunk of `size` neighbouring frames each belongs to."""
    return number_rows(frames, order, start=0).withColumn("chunk", F.floor(F.col("rn") / size).cast("long")).drop("rn")


def camera_groups(frames: DataFrame) -> DataFrame:
    """(node_id, camera_id): frames with equal size and intrinsics (to a thousandth) share a camera; cameras are numbered from 1
    by their first frame."""
    key = [F.col("width"), F.col("height"), *(F.round(F.col(c) * 1000).cast("long").alias(f"k_{c}") for c in ("fx", "fy", "cx", "cy"))]
    keyed = frames.select("node_id", *key)
    names = [c for c in keyed.columns if c != "node_id"]
    cameras = number_rows(keyed.groupBy(*names).agg(F.min("node_id").alias("first")), "first", name="camera_id")
    return keyed.join(cameras, names).select("node_id", "camera_id")


def first_per(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
