"""Joins that pick one partner: nearest in time, cheapest wall, overlapping boxes, frame pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.spatial import radius_join

#: Buckets of time to a span, and spans to an age.
BUCKETS = 1_024


def micros(c: str | Column) -> Column:
    """A timestamp with or without zone as microseconds (the session's zone is UTC)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def nearest_in_time(queries: DataFrame, frames: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """(query_id, node_id, dt_us): per query (query_id, ts) the frame (node_id, ts) nearest in time, the smaller id of two equally
    near. Null times match nothing.

    Both are sorted within buckets of time only; what precedes and follows a bucket comes from a table with one row per
    bucket, so no task sees the whole time line and nothing is compared pairwise."""
    width = bucket_s * 1_000_000
    f = frames.where("ts is not null").select(micros("ts").alias("t"), "node_id").groupBy("t").agg(F.min("node_id").alias("node_id"))
    f = f.withColumn("bucket", F.floor(F.col("t") / width))
    q = queries.where("ts is not null").select("query_id", micros("ts").alias("t")).withColumn("bucket", F.floor(F.col("t") / width))
    one = F.struct("t", "node_id")
    ends = f.select("bucket", one.alias("f")).unionByName(q.select("bucket").distinct().withColumn("f", F.lit(None).cast("struct<t:bigint,node_id:bigint>"))).groupBy("bucket").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    # what comes before and after a bucket, first within spans of BUCKETS buckets, then over the spans (one row each, 43 days for buckets of an hour)
    ends = ends.withColumn("span", F.floor(F.col("bucket") / BUCKETS))
    w = Window.partitionBy("span").orderBy("bucket")
    spans = ends.groupBy("span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    v = Window.partitionBy(F.floor(F.col("span") / BUCKETS)).orderBy("span")
    far = spans.groupBy(F.floor(F.col("span") / BUCKETS).alias("age")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    u = Window.partitionBy(F.lit(0)).orderBy("age")  # one row per 5,000 years at buckets of an hour
    before, after = (lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))), (lambda c, w: F.first(c, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    far = far.select("age", before("hi", u).alias("before3"), after("lo", u).alias("after3"))
    spans = spans.select("span", F.floor(F.col("span") / BUCKETS).alias("age"), before("hi", v).alias("before2"), after("lo", v).alias("after2")).join(far, "age").drop("age")
    ends = ends.select("span", "bucket", before("hi", w).alias("before"), after("lo", w).alias("after")).join(spans, "span")
    ends = ends.select("bucket", F.coalesce("before", "before2", "before3").alias("before"), F.coalesce("after", "after2", "after3").alias("after"))
    both = f.select("bucket", "t", one.alias("f"), F.lit(None).cast("long").alias("query_id"), F.lit(False).alias("is_query")).unionByName(
        q.select("bucket", "t", F.lit(None).cast("struct<t:bigint,node_id:bigint>").alias("f"), F.col("query_id").cast("long").alias("query_id"), F.lit(True).alias("is_query")))
    in_ = Window.partitionBy("bucket").orderBy("t", "is_query")
    both = both.select("*", F.last("f", ignorenulls=True).over(in_.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.first("f", ignorenulls=True).over(in_.rowsBetween(0, Window.unboundedFollowing)).alias("n"))
    m = both.where("is_query").join(ends, "bucket", "left").select("query_id", "t", F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"))
    cost = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("dt_us"), F.col(f"{c}.node_id").alias("node_id")))
    return m.withColumn("best", F.least(cost("p"), cost("n"))).where("best is not null").select("query_id", "best.node_id", "best.dt_us")


def cheapest_wall(instances: DataFrame, walls: DataFrame, angle_weight: float = 1.0, distance_weight: float = 0.5, least_deg: float = 40.0, most_deg: float = 60.0, most_walls: int = 100_000) -> DataFrame:
    """(instance_id, wall_id, cost): per instance (instance_id, nx, ny, nz, x, y, z, flatness) the wall (wall_id, a, b, c, d) with the lowest
    angle + distance cost within the tolerated angle, which grows from least to most with lack of flatness. Instances
    no wall suits have a null wall.

    Walls are the planes of a building and are sent to every task in blocks of at most about `most_walls`, and the cheapest of all blocks is
    taken."""
    blocks = max(1, -(-walls.count() // most_walls))
    dot = F.abs(F.col("nx") * F.col("a") + F.col("ny") * F.col("b") + F.col("nz") * F.col("c"))
    angle = F.acos(F.least(F.lit(1.0), dot))
    far = F.abs(F.col("x") * F.col("a") + F.col("y") * F.col("b") + F.col("z") * F.col("c") + F.col("d"))
    bound = F.radians(F.lit(least_deg) + (most_deg - least_deg) * (1 - F.col("flatness")))
    cost = angle_weight * angle + distance_weight * far
    j = None
    for k in range(blocks):
        part = walls if blocks == 1 else walls.where(F.pmod(F.xxhash64("wall_id"), F.lit(blocks)) == k)
        one = instances.join(F.broadcast(part), angle <= bound).groupBy("instance_id").agg(F.min(F.struct(cost.alias("cost"), "wall_id")).alias("m"))
        j = one if j is None else j.unionByName(one)
    j = j.groupBy("instance_id").agg(F.min("m").alias("m"))
    return instances.select("instance_id").join(j, "instance_id", "left").select("instance_id", "m.wall_id", "m.cost")


def iou_pairs(boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """(image, class, a, b, iou) of overlapping boxes (image, class, box_id, x1, y1, x2, y2, score) of one image and class, a the one with
    the higher score. Images bound the groups."""
    a, b = boxes.alias("a"), boxes.alias("b")
    first = (F.col("a.score") > F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col("a.box_id") < F.col("b.box_id")))
    j = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.class") == F.col("b.class")) & first)
    w = F.greatest(F.lit(0.0), F.least("a.x2", "b.x2") - F.greatest("a.x1", "b.x1"))
    h = F.greatest(F.lit(0.0), F.least("a.y2", "b.y2") - F.greatest("a.y1", "b.y1"))
    area = lambda s: (F.col(f"{s}.x2") - F.col(f"{s}.x1")) * (F.col(f"{s}.y2") - F.col(f"{s}.y1"))
    iou = w * h / (area("a") + area("b") - w * h)
    return j.select("a.image", "a.class", F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"), iou.alias("iou")).where(F.col("iou") > least)


def frame_pairs(frames: DataFrame, window: int = 5, radius: float = 1.0, view: float = 0.5) -> DataFrame:
    """(a, b) of frames (point_idx, x, y, z, vx, vy, vz) at most `window` apart in order, or with centres within the radius and views
    that agree. The order is joined by position and offset, the place on the grid."""
    near = frames.select(F.col("point_idx").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(window))).alias("k")).withColumn("b", F.col("a") + F.col("k"))
    near = near.join(frames.select(F.col("point_idx").alias("b")), "b", "left_semi").select("a", "b")
    other = frames.select("point_idx", "x", "y", "z", *(F.col(c).alias(f"w{c[1]}") for c in ("vx", "vy", "vz")))
    j = radius_join(frames, other, radius, keep_a=("vx", "vy", "vz"), keep_b=("wx", "wy", "wz")).where("a < b").where(F.expr("vx*wx + vy*wy + vz*wz") >= view)
    return near.unionByName(j.select("a", "b")).distinct()
