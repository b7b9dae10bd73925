"""Tables and frames out of SQLite files (project databases and SLAM databases). Python's sqlite3 reads a file in one task; files are spread over tasks."""

from __future__ import annotations

import sqlite3
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, paths: list[str], table: str, schema: str, batch: int = 10_000) -> DataFrame:
    """Rows of one table of several databases; `schema` names the columns to read. Paths must be readable by all executors; a missing table gives no rows."""
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def run(parts):
        for f in parts:
            for p in f.path:
                db = sqlite3.connect(f"file:{p}?mode=ro&immutable=1", uri=True)
                try:
                    if not db.execute("select 1 from sqlite_master where name = ?", (table,)).fetchone():
                        continue
                    cur = db.execute("select {} from \"{}\"".format(", ".join(f'"{n}"' for n in names), table.replace('"', "")))
                    while rows := cur.fetchmany(batch):
                        yield pd.DataFrame(rows, columns=names)
                finally:
                    db.close()

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, schema)


def pose_matrix(blob: bytes | None) -> list[float]:
    """A row-major 4x4 matrix from twelve 32-bit floats; the identity where there are none."""
    m = np.eye(4)
    if blob and len(blob) >= 48:
        m[:3] = np.frombuffer(blob[:48], "<f4").reshape(3, 4)
    return m.ravel().astype(float).tolist()


def read_slam_frames(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(node_id, timestamp, pose, color, depth) of SLAM databases: one frame per node with a colour image; a stamp that isn't positive is -1. The optimised poses of the Admin table (node ids and
    matrices, packed) replace those of the nodes."""

    def run(parts):
        for f in parts:
            for p in f.path:
                db = sqlite3.connect(f"file:{p}?mode=ro&immutable=1", uri=True)
                best = _optimised(db)
                cur = db.execute("select n.id, n.stamp, n.pose, d.image, d.depth from Node n join Data d on d.id = n.id where d.image is not null and length(d.image) > 0 order by n.id")
                while rows := cur.fetchmany(64):
                    yield pd.DataFrame([(i, t if t and t > 0 else -1.0, best.get(i) or pose_matrix(m), c, d) for i, t, m, c, d in rows], columns=["node_id", "timestamp", "pose", "color", "depth"])
                db.close()

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, "node_id long, timestamp double, pose array<double>, color binary, depth binary")


def _optimised(db: sqlite3.Connection) -> dict[int, list[float]]:
    try:
        row = db.execute("select opt_ids, opt_poses from Admin").fetchone()
    except sqlite3.Error:
        return {}
    if not row or not row[0] or not row[1]:
        return {}
    unpack = lambda b, kind: np.frombuffer(zlib.decompress(b[:-12]) if len(b) > 12 and b[:2] in (b"x\x9c", b"x\x01", b"x\xda") else b, kind)
    try:
        ids, poses = unpack(row[0], "<i4"), unpack(row[1], "<f4")
    except (zlib.error, ValueError, struct.error):
        return {}
    if len(poses) != 12 * len(ids):
        return {}
    return {int(i): pose_matrix(p.tobytes()) for i, p in zip(ids, poses.reshape(-1, 12))}
