"""Streams. The reference has no streaming of its own; its pipeline log is the one append-only table, so this is an extension: the log as a stream, with late entries
and repeats, and frames as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import images


def read_log(spark: SparkSession, folder: str, schema: str, per_batch: int = 16) -> DataFrame:
    """Log entries of the parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def without_repeats(log: DataFrame, time: str = "ts", key: tuple[str, ...] = ("event_id",), late: str = "1 hour") -> DataFrame:
    """Each entry once, as long as its repeat comes within the watermark; the state of older keys is dropped."""
    return log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def stage_activity(log: DataFrame, window: str = "10 minutes", time: str = "ts", stage: str = "event_type", late: str | None = "1 hour") -> DataFrame:
    """(start, stage, n, mean) per window, final once the watermark has passed it. `late` is None where the stream has a watermark already."""
    if late is not None:
        log = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = log.groupBy(F.window(time, window), stage)
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), stage, "n", "mean")


def frame_points(frames: DataFrame, **how: float) -> DataFrame:
    """World points of frames as they arrive: row-wise, so it needs no state."""
    return images.world_points(frames, **how)


def store_batches(stream: DataFrame, folder: str, checkpoint: str, key: tuple[str, ...] = ("event_id",)):
    """Write a stream into a folder, one subfolder per batch. A batch that is run again after a failure overwrites its own subfolder, so every row is stored once."""

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(list(key)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
