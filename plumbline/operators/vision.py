"""Operators on detections and masks. Models are injected: a scorer is any function from a batch of images to detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corners(boxes: DataFrame) -> DataFrame:
    """Boxes given by centre and size (cx, cy, w, h) with corners x1, y1, x2, y2."""
    return boxes.withColumns({"x1": F.col("cx") - F.col("w") / 2, "y1": F.col("cy") - F.col("h") / 2, "x2": F.col("cx") + F.col("w") / 2, "y2": F.col("cy") + F.col("h") / 2})


def centres(boxes: DataFrame) -> DataFrame:
    """Boxes given by corners with centre and size."""
    return boxes.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})


def keep_boxes(box: np.ndarray, score: np.ndarray, iou: float) -> np.ndarray:
    """Indices kept by greedy suppression, best first; equal scores keep their order."""
    order = np.argsort(-score, kind="stable")
    area = np.maximum(box[:, 2] - box[:, 0], 0) * np.maximum(box[:, 3] - box[:, 1], 0)
    keep = []
    while len(order):
        i, order = order[0], order[1:]
        keep.append(i)
        w = np.minimum(box[i, 2], box[order, 2]) - np.maximum(box[i, 0], box[order, 0])
        h = np.minimum(box[i, 3], box[order, 3]) - np.maximum(box[i, 1], box[order, 1])
        inter = np.maximum(w, 0) * np.maximum(h, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            order = order[~(inter / (area[i] + area[order] - inter) > iou)]
    return np.array(keep, int)


def suppress(boxes: DataFrame, iou: float = 0.45, confidence: float = 0.0, most: int | None = None) -> DataFrame:
    """The boxes (image, class, box_id, x1, y1, x2, y2, score) above the confidence that greedy suppression keeps, per image and class; with `most` only so many of an image, best first
    (the operator's cap on detections). Greedy suppression is sequential, but an image's boxes are few."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("box_id", kind="stable").reset_index(drop=True)
        parts = [g.iloc[keep_boxes(g[["x1", "y1", "x2", "y2"]].to_numpy(float), g.score.to_numpy(float), iou)] for _, g in f.groupby("class", sort=True)]
        out = pd.concat(parts).sort_values(["score", "box_id"], ascending=[False, True], kind="stable")
        return out if most is None else out.head(most)

    cols = ["image", "class", "box_id", "x1", "y1", "x2", "y2", "score"]
    b = boxes.select(*cols).where(F.col("score") > confidence)
    return b.groupBy("image").applyInPandas(one, b.schema)


def best_class(rows: DataFrame) -> DataFrame:
    """Detections with an array of class scores: class (the first of the greatest) and score."""
    return rows.withColumn("score", F.array_max("scores")).withColumn("class", (F.array_position("scores", F.col("score")) - 1).cast("int"))


def letterbox(rows: DataFrame, width: int, height: int) -> DataFrame:
    """How an image (iw, ih) goes into a frame of another size: scale, padding left and top, and the size inside."""
    s = F.least(F.lit(width) / F.col("iw"), F.lit(height) / F.col("ih"))
    w, h = F.round(F.col("iw") * s).cast("int"), F.round(F.col("ih") * s).cast("int")
    return rows.withColumns({"scale": s, "w": w, "h": h, "left": F.floor((width - w) / 2).cast("int"), "top": F.floor((height - h) / 2).cast("int")})


def unletterbox(boxes: DataFrame) -> DataFrame:
    """Boxes in the letterboxed frame back in the image, cut at its borders."""
    back = lambda c, pad, size: F.greatest(F.lit(0.0), F.least(F.col(size).cast("double"), (F.col(c) - F.col(pad)) / F.col("scale")))
    return boxes.withColumns({c: back(c, "left" if c[0] == "x" else "top", "iw" if c[0] == "x" else "ih") for c in ("x1", "x2", "y1", "y2")})


def decode_masks(coefficients: np.ndarray, prototypes: np.ndarray, boxes: np.ndarray, classes: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """A label image from mask coefficients (n, k), prototypes (k, h, w) and boxes in its pixels: class + 1 where sigmoid(coefficients . prototypes) exceeds the threshold inside
    the box; later detections win."""
    k, h, w = prototypes.shape
    out = np.zeros((h, w), np.int32)
    for c, b, cls in zip(coefficients, boxes, classes):
        x1, y1, x2, y2 = (int(v) for v in np.clip(np.floor([b[0], b[1], np.ceil(b[2]), np.ceil(b[3])]), 0, [w, h, w, h]))
        part = 1 / (1 + np.exp(-np.tensordot(c, prototypes[:, y1:y2, x1:x2], 1)))
        out[y1:y2, x1:x2][part > threshold] = cls + 1
    return out


def presence_filter(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detections (logit, presence, box, width, height) whose sigmoid(logit) times presence reaches the threshold, boxes cut at the image's borders."""
    score = 1 / (1 + F.exp(-F.col("logit"))) * F.col("presence")
    cut = lambda c, size: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(size).cast("double")))
    return rows.withColumn("score", score).where(F.col("score") >= threshold).withColumns({c: cut(c, "width" if c[0] == "x" else "height") for c in ("x1", "x2", "y1", "y2")})


def annotate(frames: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, done: DataFrame | None = None, batch: int = 32) -> DataFrame:
    """Run a scorer over frames in batches of fixed size; frames that are `done` (node_id) are left out. Batches are Arrow batches, so a task holds one at a time."""
    todo = frames if done is None else frames.join(done.select("node_id").distinct(), "node_id", "left_anti")

    def run(parts: Iterator[pd.DataFrame]):
        for f in parts:
            for i in range(0, len(f), batch):
                yield scorer(f.iloc[i : i + batch].reset_index(drop=True))

    return todo.mapInPandas(run, schema)


def largest_part(mask: np.ndarray) -> np.ndarray:
    """The largest 4-connected part of a mask, the one met first in reading order of equally large ones."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:, 1:], np.s_[:, :-1])):
            both = mask[a] & mask[b]
            low = np.where(both, np.minimum(np.where(new[a] > 0, new[a], mask.size + 1), np.where(new[b] > 0, new[b], mask.size + 1)), 0)
            for s in (a, b):
                new[s] = np.where(both, np.minimum(new[s], low), new[s])
        if np.array_equal(new, label):
            break
        label = new
    ids, n = np.unique(label[label > 0], return_counts=True)
    return label == ids[n.argmax()] if len(ids) else mask


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """All rows in a random order that the seed decides, by a range shuffle."""
    return rows.orderBy(F.rand(seed), *rows.columns[:1])
