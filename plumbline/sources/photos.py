"""Survey photos and panoramas: JPEG files with sidecars or EXIF times, matched to the frame nearest in time."""

from __future__ import annotations

import datetime as dt
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import filename_epoch, filename_id, utc_epoch
from plumbline.operators.matching import nearest_in_time

#: EXIF tags of a picture's time, the one to prefer first, and of the block they stand in.
TIME_TAGS, EXIF_BLOCK = (0x9003, 0x9004, 0x0132), 0x8769


def exif_time(data: bytes) -> str | None:
    """The time a JPEG was taken, as `YYYY:MM:DD HH:MM:SS`, or None."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _tiff_time(data[at + 10 : at + 2 + size])
        at += 2 + size
    return None


def _tiff_time(t: bytes) -> str | None:
    order = {b"II": "<", b"MM": ">"}.get(t[:2])
    if not order or len(t) < 8:
        return None
    found: dict[int, str] = {}
    todo, seen = [struct.unpack_from(order + "I", t, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(t):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", t, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(t):
                break
            tag, _, n, value = struct.unpack_from(order + "HHII", t, entry)
            if tag == EXIF_BLOCK:
                todo.append(value)
            elif tag in TIME_TAGS and n >= 19:
                found[tag] = t[value : value + 19].decode("latin-1")
    return next((found[k] for k in TIME_TAGS if k in found), None)


def read_panoramas(spark: SparkSession, path: str, utc_offset_h: float = 0.0) -> DataFrame:
    """(filename, timestamp, data) of the JPEG files under a path; the local EXIF time is moved to UTC by the offset, -1 without one."""

    def run(parts):
        for f in parts:
            out = []
            for data in f.content:
                t = exif_time(data)
                try:
                    out.append(dt.datetime.strptime(t or "", "%Y:%m:%d %H:%M:%S").replace(tzinfo=dt.UTC).timestamp() - 3600 * utc_offset_h)
                except ValueError:
                    out.append(-1.0)
            yield pd.DataFrame({"path": f.path, "timestamp": out, "data": f.content})

    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.jpe?g$")).select("path", "content")
    return files.mapInPandas(run, "path string, timestamp double, data binary").select(F.substring_index("path", "/", -1).alias("filename"), "timestamp", "data")


def new_panoramas(panoramas: DataFrame, stored: DataFrame, frames: DataFrame) -> DataFrame:
    """(filename, timestamp, data, node_id): panoramas whose file isn't stored yet, with the frame (node_id, timestamp) nearest in time; null without a time."""
    new = panoramas.join(stored.select("filename").distinct(), "filename", "left_anti")
    return _with_frame(new, "filename", frames)


def read_photos(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, photo_id, timestamp, image) of the JPEG files in a folder: `capturedAt` and `id` of the JSON sidecar of the same stem, else from the file's name; the image in base64."""
    pictures = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.jpe?g$"))
    stem = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")
    p = pictures.select(F.substring_index("path", "/", -1).alias("filename"), stem(F.col("path")).alias("stem"), F.base64("content").alias("image"))
    side = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.json$")).select(stem(F.col("path")).alias("stem"), F.from_json(F.decode("content", "UTF-8"), "capturedAt string, id string").alias("s"))
    j = p.join(side, "stem", "left")
    t = utc_epoch("s.capturedAt")
    return j.select("filename", F.coalesce("s.id", filename_id("stem")).alias("photo_id"), F.when(t >= 0, t).otherwise(filename_epoch("stem")).alias("timestamp"), "image")


def photos_with_frames(photos: DataFrame, frames: DataFrame) -> DataFrame:
    """Photos with the node_id of the frame nearest in time. The link is a column of its own, so two photos of one frame don't collide."""
    return _with_frame(photos, "filename", frames)


def _with_frame(rows: DataFrame, key: str, frames: DataFrame) -> DataFrame:
    at = lambda c: F.when(F.col(c) >= 0, F.timestamp_micros((F.col(c) * 1_000_000).cast("long")))
    q = rows.select(F.xxhash64(key).alias("query_id"), at("timestamp").alias("ts"))
    near = nearest_in_time(q.distinct(), frames.select("node_id", at("timestamp").alias("ts"))).select("query_id", "node_id")
    return rows.withColumn("query_id", F.xxhash64(key)).join(near, "query_id", "left").drop("query_id")
