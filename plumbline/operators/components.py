"""Connected components over a table of links, by alternating large-star and small-star rounds.

Each round replaces links by links to smaller nodes; the minimum of a node's neighbours is a partial aggregate before
any shuffle, so a node with a third of all links costs no more than its share. Rounds grow with the logarithm of the
longest path. Every round is written to the shared folder, so no lineage piles up and a lost executor costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage, unstage


def _directed(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    both = _directed(e)
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (columns a, b) touches; the component is its smallest node. Null ends
    and loops are ignored; no links give no rows."""
    e = stage(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    mark = None
    while True:
        new = stage(_small_star(_large_star(e)))
        got = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        unstage(e)
        e = new
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
