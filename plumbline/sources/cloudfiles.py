"""Point-cloud files: PLY and PCD read by Arrow batches of whole files, plane text, and their writers.

A file is one task's work; `binaryFile` spreads files over tasks. Points come out as rows (cloud, point_idx, x, y, z, r, g, b, nx, ny, nz, label, intensity), missing fields null; `clouds_of` splits
them into position, normal and label clouds.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import gray

POINTS = "cloud string, point_idx long, x float, y float, z float, r short, g short, b short, nx float, ny float, nz float, label long, intensity float"
#: Names of types and fields in the formats.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
             "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
ALIASES = {"red": "r", "green": "g", "blue": "b", "diffuse_red": "r", "diffuse_green": "g", "diffuse_blue": "b", "normal_x": "nx", "normal_y": "ny", "normal_z": "nz", "scalar_label": "label"}


def parse_ply(data: bytes) -> pd.DataFrame:
    """The vertices of a PLY file (ascii or binary). ValueError if it is none, has no positions or no points."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("no PLY file")
    body = data.index(b"\n", end) + 1
    fmt, elements = "ascii", []
    for line in data[:end].decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            fmt = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    order = ">" if fmt == "binary_big_endian" else "<"
    at = body
    for name, n, props in elements:
        if name != "vertex":
            if any(p[0] == "list" for p in props) or fmt == "ascii":
                raise ValueError("an element before the vertices can't be skipped") if name != "face" else ValueError("faces before vertices")
            at += n * np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in props]).itemsize
            continue
        names = [ALIASES.get(p[-1], p[-1]) for p in props]
        if not {"x", "y", "z"} <= set(names):
            raise ValueError("no positions")
        if not n:
            raise ValueError("no points")
        if fmt == "ascii":
            rows = data[at:].decode("latin-1").split("\n", n)[:n]
            v = np.array([r.split()[: len(names)] for r in rows], float)
            return pd.DataFrame(dict(zip(names, v.T)))
        raw = np.frombuffer(data, np.dtype([(k, order + PLY_TYPES[p[0]]) for k, p in zip(names, props)]), n, at)
        return pd.DataFrame({k: raw[k].astype(raw[k].dtype.newbyteorder("=")) for k in names})
    raise ValueError("no vertices")


def parse_pcd(data: bytes) -> pd.DataFrame:
    """The points of a PCD file (ascii, binary or binary_compressed)."""
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("no PCD file")
        w = data[at:end].decode("latin-1").split()
        at = end + 1
        if w and w[0] != "#":
            head[w[0]] = w[1:]
    names = [ALIASES.get(f, f) for f in head["FIELDS"]]
    count = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    types = [f"<{ {'F': 'f', 'I': 'i', 'U': 'u'}[t] }{s}" for t, s in zip(head["TYPE"], head["SIZE"])]
    n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    kind = head["DATA"][0]
    if kind == "ascii":
        v = pd.read_csv(io.BytesIO(data[at:]), sep=r"\s+", header=None, nrows=n).to_numpy(float)
        at_col = np.concatenate([[0], np.cumsum(count)])
        out = {k: v[:, at_col[i]] for i, k in enumerate(names)}
        if "rgb" in out and head["TYPE"][names.index("rgb")] == "F":
            out["rgb"] = out["rgb"].astype("<f4").view("<u4")
    else:
        if kind == "binary_compressed":
            packed, size = struct.unpack_from("<II", data, at)
            data, at = _unpack(data[at + 8 : at + 8 + packed], size), 0
            out, pos = {}, 0
            for k, t, c in zip(names, types, count):
                out[k] = np.frombuffer(data, t, n * c, pos)[::c]
                pos += n * c * np.dtype(t).itemsize
        else:
            raw = np.frombuffer(data, np.dtype([(f"{k}{i}", t, (c,) if c > 1 else ()) for i, (k, t, c) in enumerate(zip(names, types, count))]), n, at)
            out = {k: (raw[f"{k}{i}"] if count[i] == 1 else raw[f"{k}{i}"][:, 0]) for i, k in enumerate(names)}
        if "rgb" in out:
            out["rgb"] = np.ascontiguousarray(out["rgb"]).view("<u4")
    for k in ("rgb", "rgba"):
        if k in out:
            v = out.pop(k).astype(np.uint32)
            out |= {"r": v >> 16 & 255, "g": v >> 8 & 255, "b": v & 255}
    return pd.DataFrame(out)


def _unpack(data: bytes, size: int) -> bytes:
    """LZF: control bytes below 32 announce that many literals and one, others a copy of what was written."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
        else:
            n = c >> 5
            if n == 7:
                n += data[i]
                i += 1
            back = len(out) - ((c & 31) << 8) - data[i] - 1
            i += 1
            for k in range(n + 2):
                out.append(out[back + k])
    if len(out) != size:
        raise ValueError("the packed data are damaged")
    return bytes(out)


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """All points of the .ply and .pcd files under a path (may be a glob); the cloud is the file's stem."""
    names = [f.split()[0] for f in POINTS.split(", ")]

    def run(parts):
        for f in parts:
            for p, content in zip(f.path, f.content):
                stem, _, ext = p.rsplit("/", 1)[-1].rpartition(".")
                v = parse_ply(content) if ext.lower() == "ply" else parse_pcd(content)
                for a in range(0, len(v), 100_000):
                    part = v.iloc[a : a + 100_000]
                    d = {"cloud": stem, "point_idx": np.arange(a, a + len(part))}
                    yield pd.DataFrame(d | {k: part[k].to_numpy() if k in part else pd.array([None] * len(part), dtype="Float64") for k in names[2:]}, index=range(len(part)))[names]

    return spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(ply|pcd)$")).select("path", "content").mapInPandas(run, POINTS)


def clouds_of(points: DataFrame) -> dict[str, DataFrame]:
    """The clouds a file's points make: `colour` always (colours from intensity where there are none), `normals` and `labels` where some are not trivial."""
    i = F.col("intensity").cast("double")
    ok = i.isNotNull() & ~F.isnan(i) & (F.abs(i) < float("inf"))
    span = points.groupBy("cloud").agg(F.min(F.when(ok, i)).alias("lo"), F.max(F.when(ok, i)).alias("hi"))
    hi = F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1)
    shade = gray("intensity", F.col("lo"), hi)
    colour = points.join(span, "cloud").select("cloud", "point_idx", "x", "y", "z", *(F.coalesce(c, F.when(F.col("lo").isNotNull(), shade), F.lit(0).cast("short")).alias(c) for c in "rgb"))
    some = points.groupBy("cloud").agg(F.max((F.col("nx") != 0) | (F.col("ny") != 0) | (F.col("nz") != 0)).alias("n"), F.max(F.col("label") != 0).alias("l"))
    of = lambda c: some.where(c).select("cloud")
    return {"colour": colour, "normals": points.join(of("n"), "cloud", "left_semi").select("cloud", "point_idx", "nx", "ny", "nz"), "labels": points.join(of("l"), "cloud", "left_semi").select("cloud", "point_idx", "label")}


def _fields(points: DataFrame) -> list[tuple[str, str, str]]:
    have = set(points.columns)
    out = [(c, c, "float") for c in ("x", "y", "z")]
    out += [(c, n, "uchar") for c, n in (("r", "red"), ("g", "green"), ("b", "blue")) if c in have]
    return out + [(c, c, "float") for c in ("nx", "ny", "nz") if c in have] + [(c, c, "uint") for c in ("label",) if c in have]


def ply_bytes(f: pd.DataFrame, fields: list[tuple[str, str, str]]) -> bytes:
    head = "ply\nformat binary_little_endian 1.0\nelement vertex %d\n%send_header\n" % (len(f), "".join(f"property {t} {n}\n" for _, n, t in fields))
    raw = np.zeros(len(f), np.dtype([(n, "<" + PLY_TYPES[t]) for _, n, t in fields]))
    for c, n, _ in fields:
        raw[n] = f[c].to_numpy()
    return head.encode() + raw.tobytes()


def write_ply(points: DataFrame, folder: str, normals: DataFrame | None = None) -> DataFrame:
    """One binary PLY file per cloud in a folder all executors can write to; returns (cloud, path, n) once written. With normals of other size than the points ValueError. A file is one stream, so a cloud is one
    task's work; clouds are spread over tasks."""
    if normals is not None:
        sizes = points.groupBy("cloud").count().join(normals.groupBy("cloud").agg(F.count("*").alias("m")), "cloud", "left").where("m is null or m <> count")
        if sizes.limit(1).count():
            raise ValueError("a cloud and its normals differ in size")
        points = points.join(normals, ["cloud", "point_idx"])
    fields = _fields(points)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("point_idx")
        path = f"{folder.removeprefix('file://')}/{f.cloud.iloc[0]}.ply"
        with open(path, "wb") as out:
            out.write(ply_bytes(f, fields))
        return pd.DataFrame({"cloud": [f.cloud.iloc[0]], "path": [path], "n": [len(f)]})

    return points.groupBy("cloud").applyInPandas(one, "cloud string, path string, n long")


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(plane_id, coefficients, x, y, z, inliers) of `.planes` text: per line a count and that many coefficients, a count and that many point indices, and the centroid where it is given; `#` starts a comment."""
    line = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id()).where("trim(value) <> '' and value not like '#%'").withColumn("w", line)
    n = F.col("w")[0].cast("int")
    m = F.element_at("w", n + 2).cast("int")
    rest = F.slice("w", n + m + 3, F.lit(3))
    num = lambda a, t: F.transform(a, lambda x: x.cast(t))
    return rows.select(F.col("_id").alias("plane_id"), num(F.slice("w", F.lit(2), n), "double").alias("coefficients"), num(F.slice("w", n + 3, m), "long").alias("inliers"), *(F.get(rest, i).cast("double").alias(a) for i, a in enumerate("xyz")))


def decode_blobs(chunks: DataFrame) -> DataFrame:
    """(cloud_id, point_idx, x, y, z, r, g, b, label) of stored blobs (cloud_id, point_type, data) with whole points: three floats and a packed colour, three floats, or one unsigned label each. Other types give no rows."""

    def run(parts):
        cols = ["cloud_id", "point_idx", "x", "y", "z", "r", "g", "b", "label"]
        for f in parts:
            for cid, kind, data in zip(f.cloud_id, f.point_type, f.data):
                data = data or b""
                none = lambda n: pd.array([None] * n, dtype="Float64")
                if kind == "PointXYZRGB":
                    v = np.frombuffer(data[: len(data) // 16 * 16], "<f4").reshape(-1, 4)
                    c = v[:, 3].copy().view("<u4")
                    d = {"x": v[:, 0], "y": v[:, 1], "z": v[:, 2], "r": c >> 16 & 255, "g": c >> 8 & 255, "b": c & 255, "label": none(len(v))}
                elif kind == "PointXYZ":
                    v = np.frombuffer(data[: len(data) // 12 * 12], "<f4").reshape(-1, 3)
                    d = {"x": v[:, 0], "y": v[:, 1], "z": v[:, 2]} | {k: none(len(v)) for k in ("r", "g", "b", "label")}
                elif kind == "Label":
                    v = np.frombuffer(data[: len(data) // 4 * 4], "<u4")
                    d = {k: none(len(v)) for k in ("x", "y", "z", "r", "g", "b")} | {"label": v.astype(np.int64)}
                else:
                    continue
                yield pd.DataFrame({"cloud_id": cid, "point_idx": np.arange(len(v))} | d)[cols]

    return chunks.select("cloud_id", "point_type", "data").mapInPandas(run, "cloud_id long, point_idx long, x float, y float, z float, r short, g short, b short, label long")
