"""Rooms: sample points, link those that see each other, find communities, hand the labels on to all points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows
from plumbline.operators.spatial import propagate_labels
from plumbline.operators.voxel import uniform_sample
from plumbline.session import stage, unstage

#: Sampled points (each is a disc that can block a view) that are held by a task at once.
MOST_DISCS = 50_000


def visibility_edges(samples: DataFrame, disc: float, block: int = 64) -> DataFrame:
    """(src, dst, w) of all pairs of samples (point_idx, x, y, z, nx, ny, nz), src < dst, whose line of sight no disc of that radius around another sample
    cuts. All pairs of a sample of one building is what is asked for; its rows are split over tasks in blocks, and the discs are sent in
    blocks of MOST_DISCS: a pair sees each other if no block cuts it."""
    s = samples.select("point_idx", "x", "y", "z", "nx", "ny", "nz").orderBy("point_idx").toPandas()
    n = len(s)
    rows = samples.sparkSession.range(0, n, 1, max(1, -(-n // block))).select(F.col("id").alias("i"))
    out, blocks = None, range(0, max(n, 1), MOST_DISCS)
    for a in blocks:
        sent = samples.sparkSession.sparkContext.broadcast((s.point_idx.to_numpy(), s[["x", "y", "z"]].to_numpy(float), s[["nx", "ny", "nz"]].to_numpy(float), a))
        one = rows.mapInPandas(_free_pairs(sent, disc), "src long, dst long, w double")
        out = one if out is None else out.unionByName(one)
    return out if len(blocks) == 1 else out.groupBy("src", "dst").agg(F.count("*").alias("k")).where(F.col("k") == len(blocks)).select("src", "dst", F.lit(1.0).alias("w"))


def _free_pairs(sent, disc: float):
    """Per sample (its position i) the later ones that no disc of a block cuts off."""

    def run(parts):
        ids, p, nrm, first = sent.value
        last = min(first + MOST_DISCS, len(ids))
        discs, nrm = p[first:last], nrm[first:last]
        for f in parts:
            for i in f.i:
                q = np.arange(i + 1, len(ids))
                for a in range(0, len(q), 256):
                    j = q[a : a + 256]
                    d = p[j] - p[i]
                    # where each sight line crosses each disc's plane
                    den = d @ nrm.T
                    num = ((discs - p[i]) * nrm).sum(axis=1)[None, :]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        t = num / den
                    t[~np.isfinite(t)] = -1
                    between = (t > 1e-6) & (t < 1 - 1e-6)
                    if first <= i < last:
                        between[:, i - first] = False
                    own = (j >= first) & (j < last)
                    between[np.flatnonzero(own), j[own] - first] = False
                    r, k = np.nonzero(between)
                    hit = ((p[i] + t[r, k, None] * d[r] - discs[k]) ** 2).sum(axis=1) < disc * disc
                    blocked = np.zeros(len(j), bool)
                    blocked[r[hit]] = True
                    free = j[~blocked]
                    yield pd.DataFrame({"src": ids[i], "dst": ids[free], "w": 1.0})

    return run


def modularity_communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 20) -> DataFrame:
    """(node, community): greedy modularity by rounds of moving each node to the community of its neighbours that gains most, every second node at a time (by a
    hash, so that neighbours don't swap), until nothing moves. Communities are then merged and moved again as nodes of a smaller graph. All rounds are
    aggregates and joins; communities are numbered from 0 by their smallest node."""
    e = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst")
    e = stage(e.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    total = e.agg(F.sum("w")).first()[0]
    if not total:
        return e.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("community")).limit(0)
    member = stage(e.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
    level = e
    while True:
        degree = level.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
        state = stage(degree.withColumn("c", F.col("node")))
        any_move = False
        for r in range(rounds):
            weight = state.groupBy("c").agg(F.sum("k").alias("kc"))
            to = level.where("src <> dst").join(state.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("into"))
            own = state.select("node", "k", F.col("c").alias("c0"))
            cand = to.unionByName(state.select("node", "c", F.lit(0.0).alias("into"))).groupBy("node", "c").agg(F.sum("into").alias("into"))
            g = cand.join(own, "node").join(weight, "c").withColumn("gain", F.col("into") - resolution * F.col("k") * (F.col("kc") - F.when(F.col("c") == F.col("c0"), F.col("k")).otherwise(0.0)) / total)
            best = g.groupBy("node").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("b"), F.max(F.when(F.col("c") == F.col("c0"), F.col("gain"))).alias("stay"))
            turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
            new = stage(state.join(best, "node").select("node", "k", F.when(turn & (F.col("b.gain") > F.col("stay") + 1e-12), -F.col("b.c")).otherwise(F.col("c")).alias("c"), (turn & (F.col("b.gain") > F.col("stay") + 1e-12)).alias("moved")))
            moved = new.where("moved").count()
            unstage(state)
            state = new.drop("moved")
            any_move |= moved > 0
            if not moved and r % 2:
                break
        if not any_move:
            break
        first = stage(state.groupBy("c").agg(F.min("node").alias("to")))
        if first.count() == state.count():
            break  # nodes only changed places; nothing is left to merge
        up = state.join(first, "c").select(F.col("node").alias("c"), "to")
        member = stage(member.join(up, "c").select("node", F.col("to").alias("c")))
        a, b = up.select(F.col("c").alias("src"), F.col("to").alias("s2")), up.select(F.col("c").alias("dst"), F.col("to").alias("d2"))
        level = stage(level.join(a, "src").join(b, "dst").groupBy(F.col("s2").alias("src"), F.col("d2").alias("dst")).agg(F.sum("w").alias("w")))
    numbered = number_rows(member.groupBy("c").agg(F.min("node").alias("first")), "first", name="community", start=0)
    return member.join(numbered, "c").select("node", "community")


def segment_rooms(points: DataFrame, grid: float = 0.5, resolution: float = 1.0) -> DataFrame:
    """(point_idx, room) of points (point_idx, x, y, z, nx, ny, nz, label: the plane, 0 for none); -1 for points without a plane. Sampled points are the centres of the plane's grid cells; a disc is
    as wide as half a cell's diagonal."""
    on_plane = points.where("label > 0")
    s = stage(uniform_sample(on_plane, grid).select("point_idx").join(points, "point_idx"))
    c = stage(modularity_communities(visibility_edges(s, grid * 0.7071), resolution))
    known = s.join(c, s.point_idx == c.node, "left").select("point_idx", "x", "y", "z", F.coalesce("community", F.lit(-1)).cast("long").alias("label"))
    rest = on_plane.join(s.select("point_idx"), "point_idx", "left_anti")
    got = known.select("point_idx", "label").unionByName(propagate_labels(rest.drop("label"), known.where("label >= 0"))).withColumnRenamed("label", "room")
    return points.select("point_idx").join(got, "point_idx", "left").select("point_idx", F.coalesce("room", F.lit(-1)).alias("room"))
