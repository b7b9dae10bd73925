"""Numbering all rows of a table without putting them into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage


def number_rows(df: DataFrame, *order: str | Column, name: str = "rn", start: int = 1) -> DataFrame:
    """`df` with the position of each row in the given order. The order is a range partitioning; each partition is numbered
    by itself and shifted by the sizes of those before, of which only the counts go through the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in part.groupBy(F.shiftright("_mid", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(sizes), accumulate([0, *(sizes[p] for p in sorted(sizes))])))
    shift = F.create_map(*(F.lit(x).cast("long") for p in sorted(sizes) for x in (p, before[p]))) if sizes else None
    at = F.lit(0) if shift is None else shift[F.shiftright("_mid", 33)]
    return part.withColumn(name, (at + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + start).cast("long")).drop("_mid")
