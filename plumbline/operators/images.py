"""Operators on depth and label images, and between images and points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import geometry
from plumbline.operators.voxel import finite, stride_sample

#: Most frames one projection sends to every task; more are worked through in blocks of that many.
FRAME_BLOCK = 2_000


def project_labels(points: DataFrame, frames: DataFrame, labels: DataFrame, far: float = 7.0, near: float = 0.15) -> DataFrame:
    """(point_idx, label) of every point: the label of the pixel it is seen at, of the last frame that sees it; 0 if none does.

    Frames are (node_id, view: row-major 3x4 from world to camera, fx, fy, cx, cy, width, height), labels (node_id, u, v, label). A point is seen
    if it lies in front of the camera, not farther than `far`, inside the image, and within `near` of the nearest
    point in its pixel. Frames are matrices of a few numbers; they are sent in blocks of a checked size, and the
    nearest depth per pixel is a partial aggregate before its shuffle."""
    seen = _projected(points, frames, 0.0, far)
    pixel = ["node_id", "u", "v"]
    buffer = seen.groupBy(*pixel).agg(F.min("depth").alias("zb"))
    hit = seen.join(buffer, pixel).where(F.abs(F.col("depth") - F.col("zb")) <= near).join(labels, pixel)
    last = hit.groupBy("point_idx").agg(F.max_by("label", "node_id").alias("label"))
    return points.select("point_idx").join(last, "point_idx", "left").select("point_idx", F.coalesce("label", F.lit(0)).alias("label"))


def _projected(points: DataFrame, frames: DataFrame, least: float, far: float | None, exact: bool = False) -> DataFrame:
    """(point_idx, node_id, depth, u, v) of every point in every frame it falls into, at a depth above `least` and up to `far`; pixels are whole numbers, unless `exact`."""
    n = frames.count()
    blocks = max(1, -(-n // FRAME_BLOCK))
    seen = None
    for k in range(blocks):
        part = frames if blocks == 1 else frames.where(F.pmod(F.xxhash64("node_id"), F.lit(blocks)) == k)
        v = lambda i: F.col("view")[i]
        cam = lambda r: v(4 * r) * F.col("x") + v(4 * r + 1) * F.col("y") + v(4 * r + 2) * F.col("z") + v(4 * r + 3)
        near = (cam(2) > least) & (cam(2) <= far) if far is not None else cam(2) > least
        j = points.select("point_idx", *(F.col(a).cast("double").alias(a) for a in "xyz")).join(F.broadcast(part), near)
        j = j.select("point_idx", "node_id", cam(0).alias("px"), cam(1).alias("py"), cam(2).alias("depth"), "fx", "fy", "cx", "cy", "width", "height")
        at = lambda a: F.col(f"p{a}") * F.col(f"f{a}") / F.col("depth") + F.col(f"c{a}")
        j = j.select("point_idx", "node_id", "depth", "width", "height", *((at(a) if exact else F.round(at(a)).cast("long")).alias(u) for a, u in (("x", "u"), ("y", "v"))))
        j = j.where((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") < F.col("height")))
        seen = j if seen is None else seen.unionByName(j)
    return seen


def decode_depth(data: bytes | None, width: int, height: int) -> np.ndarray:
    """Depth in metres from 16-bit millimetres, little endian."""
    if not data:
        return np.zeros((0, 0))
    return np.frombuffer(data, "<u2", width * height).reshape(height, width).astype(np.float64) / 1000.0


def discontinuities(depth: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Where the 3x3 Sobel gradient reaches the threshold; borders are mirrored."""
    p = np.pad(depth, 1, mode="reflect") if min(depth.shape) > 1 else np.pad(depth, 1, mode="edge")
    smooth = lambda a: a[:-2] + 2 * a[1:-1] + a[2:]
    gx = smooth(p)[:, 2:] - smooth(p)[:, :-2]
    gy = smooth(p.T).T[2:] - smooth(p.T).T[:-2]
    return np.hypot(gx, gy) >= threshold


def ray_outliers(depth: np.ndarray, threshold: float = 0.2) -> np.ndarray:
    """Where the depth is not within the threshold of the 5x5 median, after a morphological opening of the consistent pixels with the
    3x3 cross."""
    p = np.pad(depth, 2, mode="edge")
    median = np.median(np.lib.stride_tricks.sliding_window_view(p, (5, 5)), axis=(2, 3))
    good = np.abs(depth - median) < threshold

    def cross(m: np.ndarray, outside: bool) -> list[np.ndarray]:
        q = np.pad(m, 1, constant_values=outside)
        return [q[1:-1, 1:-1], q[:-2, 1:-1], q[2:, 1:-1], q[1:-1, :-2], q[1:-1, 2:]]

    eroded = np.logical_and.reduce(cross(good, True))
    return ~np.logical_or.reduce(cross(eroded, False))


def filter_depth(frames: DataFrame, edge: float | None = 0.5, ray: float | None = 0.2) -> DataFrame:
    """Frames (node_id, width, height, depth, conf) with depth and confidence set to 0 at discontinuities and at outliers along the ray. A stencil per image:
    one Arrow pass, no shuffle. Frames without depth stay as they are."""

    def run(parts):
        for f in parts:
            depths, confs = [], []
            for w, h, d, c in zip(f.width, f.height, f.depth, f.conf):
                if d is None or not len(d):
                    depths.append(d)
                    confs.append(c)
                    continue
                z = decode_depth(d, w, h)
                bad = np.zeros(z.shape, bool)
                if edge is not None:
                    bad |= discontinuities(z, edge)
                if ray is not None:
                    bad |= ray_outliers(np.where(bad, 0, z), ray)
                raw = np.frombuffer(d, "<u2", w * h).reshape(h, w).copy()
                raw[bad] = 0
                depths.append(raw.tobytes())
                if c is not None and len(c) == w * h:
                    c = np.where(bad.ravel(), 0, np.frombuffer(c, np.uint8)).astype(np.uint8).tobytes()
                confs.append(c)
            yield f.assign(depth=depths, conf=confs)

    cols = ["node_id", "width", "height", "depth", "conf"]
    return frames.select(*cols).mapInPandas(run, "node_id long, width int, height int, depth binary, conf binary")


def pixels(frames: DataFrame) -> DataFrame:
    """(node_id, u, v, z, conf) of every pixel with depth."""

    def run(parts):
        for f in parts:
            for node, w, h, d, c in zip(f.node_id, f.width, f.height, f.depth, f.conf):
                z = decode_depth(d, w, h)
                v, u = np.nonzero(z > 0)
                conf = np.frombuffer(c, np.uint8).reshape(h, w)[v, u] if c is not None and len(c) == w * h else np.zeros(len(u), np.uint8)
                yield pd.DataFrame({"node_id": node, "u": u, "v": v, "z": z[v, u], "conf": conf.astype(np.int32)})

    return frames.select("node_id", "width", "height", "depth", "conf").mapInPandas(run, "node_id long, u int, v int, z double, conf int")


def world_points(frames: DataFrame, least: float = 0.0, most: float = 4.0, confidence: int = 2, step: int = 4) -> DataFrame:
    """(node_id, u, v, x, y, z) of all frames (with pose and local arrays of 16, and intrinsics): back-projected, then moved by pose times local
    transform."""
    meta = frames.select("node_id", "fx", "fy", "cx", "cy", "pose", "local")
    cam = geometry.back_project(pixels(frames).join(meta, "node_id"), least, most, confidence, step)
    return geometry.rigid(geometry.rigid(cam, F.col("local")), F.col("pose")).select("node_id", "u", "v", "x", "y", "z")


def surfels(frames: DataFrame, step: int = 4, least: int = 16) -> DataFrame:
    """Points of each frame in its optical frame (no transforms); frames with fewer than `least` give none."""
    cam = geometry.back_project(pixels(frames).join(frames.select("node_id", "fx", "fy", "cx", "cy"), "node_id"), step=step).select("node_id", "u", "v", "x", "y", "z")
    enough = cam.groupBy("node_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("node_id")
    return cam.join(enough, "node_id", "left_semi")


def label_metadata(labels: DataFrame) -> DataFrame:
    """(node_id, classes) of label images as (node_id, u, v, label): the distinct class ids from 0 up."""
    return labels.groupBy("node_id").agg(F.array_sort(F.collect_set(F.when(F.col("label") >= 0, F.col("label")))).alias("classes"))


def seed_views(points: DataFrame, frames: DataFrame, most: int | None = None) -> DataFrame:
    """(point_idx, views): for each seed point (point_idx, x, y, z, finite) the frames (as in `project_labels`) it falls into, whatever stands before it; points no frame sees are left out. With
    `most`, every so-manieth point is taken so that at most that many are."""
    p = points.where(finite("x", "y", "z"))
    if most:
        p = stride_sample(p, most, "point_idx")
    return _projected(p, frames, 0.01, None, exact=True).groupBy("point_idx").agg(F.sort_array(F.collect_set("node_id")).alias("views"))
