"""Writers of text and payload formats: camera scenes, semantic images, content-addressed object trees."""

from __future__ import annotations

import hashlib
import json
import math
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows
from plumbline.operators.voxel import camera_groups, stride_sample


def quaternion(m: np.ndarray) -> tuple[float, float, float, float]:
    """(w, x, y, z) of a rotation matrix, w not negative."""
    k = np.array([[m[0, 0] - m[1, 1] - m[2, 2], 0, 0, 0], [m[0, 1] + m[1, 0], m[1, 1] - m[0, 0] - m[2, 2], 0, 0],
                  [m[0, 2] + m[2, 0], m[1, 2] + m[2, 1], m[2, 2] - m[0, 0] - m[1, 1], 0], [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1], np.trace(m)]]) / 3
    x, y, z, w = np.linalg.eigh(k)[1][:, -1]
    s = 1.0 if w > 0 or w == 0 and (x, y, z) > (0, 0, 0) else -1.0
    return s * w, s * x, s * y, s * z


def camera_scene(frames: DataFrame, points: DataFrame | None, most: int = 100_000) -> dict[str, DataFrame]:
    """The lines (n, line) of cameras, images and points3D of a scene of frames (node_id, pose of 16, fx, fy, cx, cy, width, height). Frames with unusable intrinsics are left out; poses are inverted (world to camera); points are a uniform stride of at most `most` (the
    format's seed cloud)."""
    f = frames.where("width > 0 and height > 0 and fx > 1e-9 and fy > 1e-9")
    f = f.join(camera_groups(f), "node_id")
    one = f.groupBy("camera_id").agg(*(F.min_by(c, "node_id").alias(c) for c in ("width", "height", "fx", "fy", "cx", "cy")))

    def cameras(parts):
        for p in parts:
            yield pd.DataFrame({"n": p.camera_id, "line": [f"{i} PINHOLE {w} {h} {fx:.10g} {fy:.10g} {cx:.10g} {cy:.10g}" for i, w, h, fx, fy, cx, cy in zip(p.camera_id, p.width, p.height, p.fx, p.fy, p.cx, p.cy)]})

    def images(parts):
        for p in parts:
            lines = []
            for n, node, cam, pose in zip(p.n, p.node_id, p.camera_id, p.pose):
                m = np.linalg.inv(np.array(pose, float).reshape(4, 4))
                q = quaternion(m[:3, :3])
                lines.append(f"{n} " + " ".join(f"{v:.17g}" for v in q) + " " + " ".join(f"{v:.10g}" for v in m[:3, 3]) + f" {cam} {node:08d}.jpg\n")
            yield pd.DataFrame({"n": p.n, "line": lines})

    out = {"cameras": one.mapInPandas(cameras, "n long, line string"), "images": number_rows(f.select("node_id", "camera_id", "pose"), "node_id", name="n").mapInPandas(images, "n long, line string")}
    if points is not None:
        kept = number_rows(stride_sample(points, most, "point_idx") if most else points, "point_idx", name="n")

        def seeds(parts):
            for p in parts:
                yield pd.DataFrame({"n": p.n, "line": [f"{n} {x:.6g} {y:.6g} {z:.6g} {r} {g} {b} 0.0" for n, x, y, z, r, g, b in zip(p.n, p.x, p.y, p.z, p.r, p.g, p.b)]})

        out["points3D"] = kept.select("n", "x", "y", "z", "r", "g", "b").mapInPandas(seeds, "n long, line string")
    return out


#: The comment lines the format's files start with.
SCENE_HEADS = {
    "cameras": ["# Camera list with one line of data per camera:", "#   CAMERA_ID, MODEL, WIDTH, HEIGHT, PARAMS[]"],
    "images": ["# Image list with two lines of data per image:", "#   IMAGE_ID, QW, QX, QY, QZ, TX, TY, TZ, CAMERA_ID, NAME", "#   POINTS2D[] as (X, Y, POINT3D_ID)"],
    "points3D": ["# 3D point list with one line of data per point:", "#   POINT3D_ID, X, Y, Z, R, G, B, ERROR, TRACK[] as (IMAGE_ID, POINT2D_IDX)"],
}


def write_scene(scene: dict[str, DataFrame], folder: str) -> None:
    """The scene's text files. The format wants one file each, so lines stream through the driver in order, a partition at a time."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, lines in scene.items():
        with (Path(folder) / f"{name}.txt").open("w") as out:
            out.write("\n".join(SCENE_HEADS[name]) + "\n")
            for row in lines.orderBy("n").toLocalIterator():
                out.write(row["line"] + "\n")


def png(image: np.ndarray) -> bytes:
    """An 8-bit RGB or 16-bit grey PNG."""
    h, w = image.shape[:2]
    colour = image.ndim == 3
    rows = (image.astype(np.uint8) if colour else image.astype(">u2")).reshape(h, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 if colour else 16, 2 if colour else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_grey16(data: bytes) -> np.ndarray:
    """The pixels of a 16-bit grey PNG as `png` writes it."""
    at, parts, size = 8, [], (0, 0)
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data, at + 8)
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    w, h = size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + 2 * w)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows can be read")
    return rows[:, 1:].copy().view(">u2").astype(np.int32)


def label_png(labels: np.ndarray) -> bytes:
    """A label image (-1 is background) as a 16-bit PNG of labels plus one."""
    return png(labels + 1)


def semantic_pngs(images: DataFrame, prefix: str = "semantic", size: int = 256) -> DataFrame:
    """(name, data) of label images (node_id, width, height, labels array<int>): labels as palette colours, background black, node ids zero-padded to the longest."""
    width = len(str(images.agg(F.coalesce(F.max("node_id"), F.lit(0))).first()[0]))
    k = np.arange(size)
    hue = (k * 0.6180339887498949) % 1.0 * 6
    level = np.choose(k % 3, [255.0, 200.0, 145.0])
    table = np.stack([level * np.clip(np.abs((hue + s) % 6 - 3) - 1, 0, 1) for s in (0, 4, 2)], axis=1).astype(np.uint8)

    def run(parts):
        for f in parts:
            out = []
            for w, h, labels in zip(f.width, f.height, f.labels):
                a = np.array(labels, int).reshape(h, w)
                rgb = table[a % size]
                rgb[a < 0] = 0
                out.append(png(rgb))
            yield pd.DataFrame({"name": [f"{prefix}_{n:0{width}d}.png" for n in f.node_id], "data": out})

    return images.select("node_id", "width", "height", "labels").mapInPandas(run, "name string, data binary")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def object_tree(root: dict, chunk: int = 5_000) -> list[dict]:
    """The objects of a tree in the order children first: each object with a `speckle_type` gets an id (MD5 of its canonical JSON), is replaced by a reference in its parent, and lists all objects below it with their
    depth in `__closure`. Long lists of numbers become chunk objects."""
    out: dict[str, dict] = {}

    def visit(value):
        """(value to put into the parent, closure of it)."""
        if isinstance(value, list):
            if len(value) > chunk and all(isinstance(v, (int, float)) for v in value):
                parts = [visit({"speckle_type": "DataChunk", "data": value[i : i + chunk]}) for i in range(0, len(value), chunk)]
            else:
                parts = [visit(v) for v in value]
            return [p for p, _ in parts], _merge(c for _, c in parts)
        if not isinstance(value, dict):
            return value, {}
        parts = {k: visit(v) for k, v in value.items()}
        below = _merge(c for _, c in parts.values())
        new = {k: p for k, (p, _) in parts.items()}
        if "speckle_type" not in value:
            return new, below
        if below:
            new["__closure"] = below
        new["id"] = hashlib.md5(canonical(new).encode()).hexdigest()
        out.setdefault(new["id"], new)
        return {"speckle_type": "reference", "referencedId": new["id"]}, {new["id"]: 1} | {k: d + 1 for k, d in below.items()}

    visit(root)
    return list(out.values())


def _merge(closures) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in closures:
        for k, d in c.items():
            out[k] = min(d, out.get(k, math.inf))
    return out


def upload_batches(objects: list[dict], most: int = 10_000_000) -> Iterator[str]:
    """JSON lists of objects, each of at most `most` characters unless one object is longer."""
    batch, size = [], 2
    for o in map(canonical, objects):
        if batch and size + len(o) + 1 > most:
            yield f"[{','.join(batch)}]"
            batch, size = [], 2
        batch.append(o)
        size += len(o) + 1
    if batch:
        yield f"[{','.join(batch)}]"
