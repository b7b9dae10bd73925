"""Neighbourhood joins on a grid: radius, k nearest, votes, outliers, weighted colours.

Points are put into cells and joined by equality of cells, so a join is a hash or merge join and never a cross join; the
exact distance is the last predicate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.voxel import AXES, finite
from plumbline.session import stage, unstage


def _cells(points: DataFrame, side: float) -> DataFrame:
    return points.withColumns({f"c{a}": F.floor(F.col(a) / F.lit(side)).cast("long") for a in AXES})


def _around(points: DataFrame) -> DataFrame:
    """Each row in its own cell and in the 26 around it."""
    out = points
    for a in AXES:
        out = out.withColumn(f"d{a}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"c{a}", F.col(f"c{a}") + F.col(f"d{a}")).drop(f"d{a}")
    return out


CELL = ("cx", "cy", "cz")


def kept(df: DataFrame, *columns: str) -> DataFrame:
    """`df` by columns in as many partitions as a shuffle of this session makes. Adaptive execution merges partitions by their bytes, and a
    neighbourhood join makes many pairs of few bytes; a number keeps it from that, and the join or window reuses the partitioning."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _xyz(points: DataFrame, side: str, *keep: str) -> DataFrame:
    return points.where(finite(*AXES)).select(F.col("point_idx").alias(side), *keep, *(F.col(a).cast("double").alias(a) for a in AXES))


def squared_distance() -> Column:
    return sum((F.col(f"a.{x}") - F.col(f"b.{x}")) * (F.col(f"a.{x}") - F.col(f"b.{x}")) for x in AXES)


def radius_join(a: DataFrame, b: DataFrame, radius: float, keep_a: tuple[str, ...] = (), keep_b: tuple[str, ...] = (), on: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, d2, ...) of all pairs within the radius, also of a point with itself; `on` are further columns to agree on."""
    left = kept(_around(_cells(_xyz(a, "a", *keep_a, *on), radius)), *on, *CELL).alias("a")
    right = kept(_cells(_xyz(b, "b", *keep_b, *on), radius), *on, *CELL).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*on, "cx", "cy", "cz")]
    j = left.join(right, same).withColumn("d2", squared_distance()).where(F.col("d2") <= radius * radius)
    return j.select("a.a", "b.b", "d2", *(F.col(f"a.{k}") for k in (*keep_a, *on)), *(F.col(f"b.{k}") for k in keep_b))


def _cell_for(points: DataFrame, size: float, want: float) -> float:
    """A side of cells of which a point's own holds about `want` points, from how many it holds at a first guess and at half of it: points
    of surfaces fill far fewer cells than those of a volume."""

    def met(s: float) -> float:
        c = _cells(points, s).groupBy("cx", "cy", "cz").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("s2"), F.sum("n").alias("s1")).first()
        return c["s2"] / c["s1"]

    for _ in range(3):
        one, half = met(size), met(size / 2)
        if want / 1.5 <= one <= want * 1.5 or one <= 1.0:
            break
        power = min(3.0, max(1.0, math.log2(max(one / half, 1.01))))
        step = min(8.0, max(1 / 8, (want / one) ** (1 / power)))
        size *= step
        if 0.8 < step < 1.25:
            break
    return size


def knn(queries: DataFrame, points: DataFrame, k: int, keep: tuple[str, ...] = (), others: bool = True, side: float | None = None) -> DataFrame:
    """(a, b, d2, rank, keep...): the k nearest points of each query point (fewer if there are fewer), by distance, then index;
    with `others` a point is not its own neighbour.

    A query is settled once its k-th neighbour is no farther than the side of a cell, as all points that near lie in the
    27 cells looked at; the rest is tried again with cells twice as wide, until the cells hold the whole cloud."""
    q, p = stage(_xyz(queries, "a")), stage(_xyz(points, "b", *keep))
    box = p.agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n")).first()
    both = q.agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if not box["n"] or both["lo_x"] is None:
        return q.join(p.drop(*AXES), F.lit(False)).select("a", "b", F.lit(0.0).alias("d2"), F.lit(0).alias("rank"), *keep)
    spans = [max(box[f"hi_{a}"], both[f"hi_{a}"]) - min(box[f"lo_{a}"], both[f"lo_{a}"]) for a in AXES]
    whole = max(*spans, 1e-12)
    volume = 1.0
    for s in spans:
        volume *= max(s, whole * 1e-3)
    size = side or _cell_for(p, max((volume * (k + 1) / box["n"]) ** (1 / 3), whole * 1e-6), 0.6 * k + 0.5)
    found, last = [], False
    w = Window.partitionBy("a").orderBy("d2", "b")
    while True:
        last = size > whole
        left, right = kept(_around(_cells(q, size)), *CELL).alias("a"), kept(_cells(p, size), *CELL).alias("b")
        j = left.join(right, [F.col(f"a.c{x}") == F.col(f"b.c{x}") for x in AXES]).withColumn("d2", squared_distance())
        if others:
            j = j.where(F.col("a.a") != F.col("b.b"))
        top = kept(j.select("a.a", "b.b", "d2", *(F.col(f"b.{c}") for c in keep)), "a").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if last:
            found.append(top)
            break
        top = stage(top)
        settled = stage(top.where((F.col("rank") == k) & (F.col("d2") <= size * size)).select("a"))
        found.append(top.join(settled, "a", "left_semi"))
        rest = stage(q.join(settled, "a", "left_anti"))
        unstage(q)
        q = rest
        if not q.limit(1).count():
            break
        size *= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("a", "b", "d2", F.col("rank").cast("int").alias("rank"), *keep)


def propagate_labels(missing: DataFrame, sampled: DataFrame) -> DataFrame:
    """(point_idx, label): each missing point takes the label of the nearest sampled one, the first of equally near ones."""
    return knn(missing, sampled, 1, keep=("label",), others=False).select(F.col("a").alias("point_idx"), "label")


def majority_vote(points: DataFrame, voters: DataFrame, radius: float, unseen: int = -1) -> DataFrame:
    """(point_idx, label): the label most voters within the radius have, the smallest of equally frequent ones; `unseen` where
    there are none."""
    votes = radius_join(points, voters, radius, keep_b=("label",)).groupBy("a", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select(F.col("a").alias("point_idx"), "m.label")
    return points.select("point_idx").join(best, "point_idx", "left").select("point_idx", F.coalesce("label", F.lit(unseen)).alias("label"))


def statistical_outliers(points: DataFrame, k: int = 50, factor: float = 1.0) -> DataFrame:
    """(point_idx, mean_distance, keep): keep if the mean distance to the k nearest others is at most mean + factor x standard
    deviation over all points."""
    d = stage(knn(points, points, k).groupBy("a").agg(F.avg(F.sqrt("d2")).alias("mean_distance")))
    s = d.agg(F.avg("mean_distance").alias("m"), F.stddev_samp("mean_distance").alias("s")).first()
    most = float("inf") if s["m"] is None else s["m"] + factor * (s["s"] or 0.0)
    return d.select(F.col("a").alias("point_idx"), "mean_distance", (F.col("mean_distance") <= F.lit(most)).alias("keep"))


def radius_outliers(points: DataFrame, radius: float, least: int = 5) -> DataFrame:
    """(point_idx, n, keep): keep if at least so many points, itself among them, lie within the radius."""
    return radius_join(points, points, radius).groupBy(F.col("a").alias("point_idx")).agg(F.count("*").alias("n")).withColumn("keep", F.col("n") >= least)


def weighted_colour(queries: DataFrame, points: DataFrame, radius: float, colours: tuple[str, ...], power: int = 2, eps: float = 1e-6) -> DataFrame:
    """Per query the mean colour of the points within the radius, weighted by 1 / (distance^power + eps)."""
    j = radius_join(queries, points, radius, keep_b=colours).withColumn("w", 1 / (F.pow(F.sqrt("d2"), power) + eps))
    return j.groupBy(F.col("a").alias("point_idx")).agg(*((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in colours))


def pca_normals(points: DataFrame, radius: float, viewpoint: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(point_idx, n, nx, ny, nz, curvature): per point the direction of least variance of the points within the radius, turned to
    the viewpoint, and the share of that variance. Sums are taken in Spark; only the 3x3 eigenproblems are Python's.
    Fewer than three neighbours give NaN."""
    import numpy as np
    import pandas as pd

    b = _xyz(points, "b").alias("p")
    j = radius_join(points, points, radius).join(b, "b")
    pairs = [(u, v) for i, u in enumerate(AXES) for v in AXES[i:]]
    g = j.groupBy("a").agg(F.count("*").alias("n"), *(F.avg(u).alias(f"m{u}") for u in AXES), *(F.covar_pop(u, v).alias(f"s{u}{v}") for u, v in pairs))
    g = g.join(_xyz(points, "a"), "a")

    def solve(frames):
        for f in frames:
            m = np.empty((len(f), 3, 3))
            for i, u in enumerate(AXES):
                for k, v in enumerate(AXES):
                    m[:, i, k] = f[f"s{min(u, v)}{max(u, v)}"]
            few = (f.n < 3).to_numpy()
            m[few] = 0
            values, vectors = np.linalg.eigh(m)
            normal = vectors[:, :, 0].copy()
            normal[few] = np.nan
            to_eye = np.array(viewpoint) - f[list(AXES)].to_numpy()
            normal[(normal * to_eye).sum(axis=1) < 0] *= -1
            total = values.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                curve = np.where(total > 0, np.maximum(values[:, 0], 0) / total, 0.0)
            yield pd.DataFrame({"point_idx": f.a, "n": f.n, "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "curvature": np.where(few, np.nan, curve)})

    return g.mapInPandas(solve, "point_idx long, n long, nx double, ny double, nz double, curvature double")
