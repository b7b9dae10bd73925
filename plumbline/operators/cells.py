"""The cell complex of a building: cells between wall lines and floors, their faces, coverage, room probabilities and labelling.

A building has tens of walls and hundreds of cells; the plane arrangement and the labelling are sequential on such small inputs and run in Python, with exact fractions where equality decides.
What touches points (coverage, rays) runs in Spark.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrangement(lines: list[tuple[float, float, float]], box: tuple[float, float, float, float]) -> list[list[tuple[Fraction, Fraction]]]:
    """The convex faces that lines (a, b, c: ax + by + c = 0) cut a box (x0, y0, x1, y1) into, counter-clockwise. Each line splits the faces it crosses, in exact arithmetic."""
    x0, y0, x1, y1 = map(Fraction, box)
    faces = [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]
    for line in lines:
        a, b, c = map(Fraction, line)
        out = []
        for f in faces:
            side = [a * x + b * y + c for x, y in f]
            if min(side) >= 0 or max(side) <= 0:
                out.append(f)
                continue
            left, right = [], []
            for (p, s), (q, t) in zip(zip(f, side), zip(f[1:] + f[:1], side[1:] + side[:1])):
                if s >= 0:
                    left.append(p)
                if s <= 0:
                    right.append(p)
                if s * t < 0:
                    cut = (p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t))
                    left.append(cut)
                    right.append(cut)
            out += [left, right]
        faces = out
    return faces


def complex_of(walls: list[tuple[float, float, float]], floors: list[float], box: tuple[float, float, float, float], margin: float = 1.0) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(cells, faces). Cells (cell, x, y, z, floor_area, volume) are one per 2-D face and gap between neighbouring floors, from below. Faces (face, a, b, kind, area, ring, a_centre): cells on both sides, b is -1 outside; upright faces have
    the gap's height times the edge's length; `ring` are the corners, `a_centre` the centre of cell a."""
    x0, y0, x1, y1 = box
    flat = arrangement(walls, (x0 - margin, y0 - margin, x1 + margin, y1 + margin))
    heights = sorted(set(floors))
    cells, faces, n = [], [], len(flat)
    area = [abs(float(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(f, f[1:] + f[:1])))) / 2 for f in flat]
    for level, (lo, hi) in enumerate(pairwise(heights)):
        for i, f in enumerate(flat):
            cx, cy = (float(sum(p[k] for p in f) / len(f)) for k in (0, 1))
            cells.append((level * n + i, cx, cy, (lo + hi) / 2, area[i], area[i] * (hi - lo)))
    # an edge is shared by two faces; a corner of one may lie inside an edge of the other, so edges are cut at all corners on them
    points = sorted({p for f in flat for p in f})
    owner: dict[tuple, list[int]] = {}
    for i, f in enumerate(flat):
        for p, q in zip(f, f[1:] + f[:1]):
            on = [r for r in points if (q[0] - p[0]) * (r[1] - p[1]) == (q[1] - p[1]) * (r[0] - p[0]) and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])]
            for s, t in pairwise(sorted(on)):
                owner.setdefault((s, t), []).append(i)
    for level, (lo, hi) in enumerate(pairwise(heights)):
        for (s, t), of in sorted(owner.items()):
            length = float((t[0] - s[0]) ** 2 + (t[1] - s[1]) ** 2) ** 0.5
            ring = [(*map(float, s), lo), (*map(float, t), lo), (*map(float, t), hi), (*map(float, s), hi)]
            faces.append((level * n + of[0], level * n + of[1] if len(of) > 1 else -1, "wall", length * (hi - lo), ring))
        for i in range(n):
            ring = lambda z: [(float(x), float(y), z) for x, y in flat[i]]  # noqa: B023, E731
            faces.append((level * n + i, (level + 1) * n + i if level + 2 < len(heights) else -1, "floor", area[i], ring(hi)))
            if level == 0:
                faces.append((i, -1, "floor", area[i], ring(lo)))
    f = pd.DataFrame(faces, columns=["a", "b", "kind", "area", "ring"])
    f["a_centre"] = [cells[a][1:4] for a in f.a]
    f.insert(0, "face", range(len(f)))
    return pd.DataFrame(cells, columns=["cell", "x", "y", "z", "floor_area", "volume"]), f


def wall_membership(cells: pd.DataFrame, pairs: list[tuple[np.ndarray, float, np.ndarray, float]]) -> dict[int, set[int]]:
    """Which wall pairs (normal, d of either side) a cell lies in: its centre is behind both planes."""
    c = cells[["x", "y", "z"]].to_numpy()
    inside = [(c @ n1 + d1 <= 0) & (c @ n2 + d2 <= 0) for n1, d1, n2, d2 in pairs]
    return {int(k): {w for w, m in enumerate(inside) if m[i]} for i, k in enumerate(cells.cell)}


def face_coverage(points: DataFrame, faces: DataFrame, step: float = 0.2) -> DataFrame:
    """(face, coverage): the share of the grid cells of a face's rectangle (face, nu, nv cells of that step, in its own frame) that a point (face, u, v) comes within half a cell of its centre of. The grid is never built: covered cells are counted from the
    points."""
    near = points.select("face", F.floor(F.col("u") / step).alias("i"), F.floor(F.col("v") / step).alias("j"), "u", "v")
    reach = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    near = near.withColumn("di", reach).withColumn("dj", reach).select("face", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "u", "v")
    hit = near.where((F.col("u") - (F.col("i") + 0.5) * step) ** 2 + (F.col("v") - (F.col("j") + 0.5) * step) ** 2 <= (step / 2) ** 2).select("face", "i", "j").distinct()
    n = hit.join(faces, "face").where((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < F.col("nu")) & (F.col("j") < F.col("nv"))).groupBy("face").agg(F.count("*").alias("n"))
    return faces.join(n, "face", "left").select("face", F.when(F.col("nu") * F.col("nv") > 0, F.coalesce("n", F.lit(0)) / (F.col("nu") * F.col("nv"))).otherwise(0.0).alias("coverage"))


def sphere_directions(n: int = 100) -> np.ndarray:
    """n directions spread evenly by the golden angle."""
    i = np.arange(n) + 0.5
    z, t = 1 - 2 * i / n, np.pi * (1 + 5**0.5) * i
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(t), r * np.sin(t), z], axis=1)


def room_probabilities(cells: DataFrame, samples: DataFrame, disc: float = 0.35, rays: int = 100, most: int = 200_000) -> DataFrame:
    """(cell, room, p) of cells (cell, x, y, z): the share of rays whose first disc (samples x, y, z, nx, ny, nz, room from 0, normals into the room) has that room, as room + 1; 0 is outside: no disc or one seen from behind. Samples
    are sent to every task in blocks of about `most`; the first disc of a ray is the first of those of all blocks."""
    names = ("x", "y", "z", "nx", "ny", "nz", "room")
    blocks = max(1, -(-samples.count() // most))
    kind = dict(cells.dtypes)["cell"]
    hits = None
    for k in range(blocks):
        part = samples if blocks == 1 else samples.where(F.pmod(F.xxhash64(*names), F.lit(blocks)) == k)
        sent = samples.sparkSession.sparkContext.broadcast(part.select(*names).toPandas().to_numpy(float))
        one = cells.select("cell", "x", "y", "z").mapInPandas(_first_discs(sent, disc, rays), f"cell {kind}, ray int, t double, room long")
        hits = one if hits is None else hits.unionByName(one)
    first = hits.groupBy("cell", "ray").agg(F.min(F.struct("t", "room")).alias("f"))
    return first.groupBy("cell", F.col("f.room").alias("room")).agg((F.count("*") / rays).alias("p"))


def _first_discs(sent, disc: float, rays: int):
    """Per cell and ray the first disc: how far, and its room + 1, or 0 if it is seen from behind or there is none (infinitely far)."""

    def run(parts):
        p, n, room = sent.value[:, :3], sent.value[:, 3:6], sent.value[:, 6].astype(int)
        d = sphere_directions(rays)
        for f in parts:
            out = []
            for cell, c in zip(f.cell, f[["x", "y", "z"]].to_numpy(float)):
                den = d @ n.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = ((p - c) * n).sum(axis=1)[None, :] / den
                t[~np.isfinite(t) | (t <= 1e-9)] = np.inf
                r, k = np.nonzero(np.isfinite(t))
                miss = ((c + t[r, k, None] * d[r] - p[k]) ** 2).sum(axis=1) > disc * disc
                t[r[miss], k[miss]] = np.inf
                first = t.argmin(axis=1) if t.shape[1] else np.zeros(rays, int)
                ok = np.isfinite(t[np.arange(rays), first]) if t.shape[1] else np.zeros(rays, bool)
                ok &= den[np.arange(rays), first] < 0 if t.shape[1] else ok
                of = np.where(ok, room[first] + 1 if len(room) else 0, 0)
                far = t[np.arange(rays), first] if t.shape[1] else np.full(rays, np.inf)
                out.append(pd.DataFrame({"cell": cell, "ray": np.arange(rays, dtype=np.int32), "t": far, "room": of.astype(np.int64)}))
            if out:
                yield pd.concat(out)

    return run


def label_cells(cells: pd.DataFrame, faces: pd.DataFrame, probability: dict[tuple[int, int], float], coverage: dict[int, float], rooms: int, alpha: float = 0.04, sweeps: int = 100) -> dict[int, int]:
    """A room (1..rooms) or outside (0) per cell that minimises - sum P(cell, room) volume + alpha sum (1 - coverage) area over faces between unlike cells. No integer solver is at hand; the same objective is minimised by
    moving one room at a time with an exact minimum cut between "keep" and "take" (alpha expansion), until nothing improves."""
    ids = [int(c) for c in cells.cell]
    volume = dict(zip(ids, cells.volume))
    edges = [(int(f.a), int(f.b), alpha * (1 - coverage.get(int(f.face), 0.0)) * f.area) for f in faces.itertuples() if f.b >= 0]
    cost = {c: [-probability.get((c, r), 0.0) * volume[c] for r in range(rooms + 1)] for c in ids}
    label = {c: min(range(rooms + 1), key=lambda r: (cost[c][r], r)) for c in ids}
    energy = lambda lab: sum(cost[c][lab[c]] for c in ids) + sum(w for a, b, w in edges if lab[a] != lab[b])
    best = energy(label)
    for _ in range(sweeps):
        before = best
        for room in range(rooms + 1):
            new = _expand(ids, edges, cost, label, room)
            if (e := energy(new)) < best - 1e-12:
                label, best = new, e
        if best >= before - 1e-12:
            break
    return label


def _expand(ids, edges, cost, label, room):
    """The best labelling in which each cell keeps its label or takes `room`: a minimum cut, by augmenting shortest paths. Cells on the source's side keep."""
    gain = {c: cost[c][room] - cost[c][label[c]] for c in ids}  # what taking costs more than keeping
    cap: dict[object, dict[object, float]] = {"s": {}, "t": {}} | {c: {} for c in ids}

    def add(u, v, w):
        cap[u][v] = cap[u].get(v, 0.0) + w
        cap[v].setdefault(u, 0.0)

    for a, b, w in edges:
        both_keep, a_keeps, b_keeps = w * (label[a] != label[b]), w * (label[a] != room), w * (label[b] != room)
        # taking is x = 1: both_keep + (b_keeps - both_keep) xa - b_keeps xb + (a_keeps + b_keeps - both_keep) (1 - xa) xb
        gain[a] += b_keeps - both_keep
        gain[b] -= b_keeps
        add(a, b, a_keeps + b_keeps - both_keep)
    for c, g in gain.items():
        add(*(("s", c) if g > 0 else (c, "t")), abs(g))
    while True:
        back, queue = {"s": None}, ["s"]
        for u in queue:
            for v, w in cap[u].items():
                if w > 1e-12 and v not in back:
                    back[v] = u
                    queue.append(v)
        if "t" not in back:
            return {c: label[c] if c in back else room for c in ids}
        path, v = [], "t"
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        flow = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= flow
            cap[v][u] += flow


def boundary_faces(faces: pd.DataFrame, label: dict[int, int], inside=lambda r: r > 0) -> pd.DataFrame:
    """The faces of which exactly one side is inside, with the inside cell as `cell`."""
    side = lambda c: inside(label.get(int(c), 0)) if c >= 0 else False
    rows = [(f.face, int(f.a if side(f.a) else f.b), f.area) for f in faces.itertuples() if side(f.a) != side(f.b)]
    return pd.DataFrame(rows, columns=["face", "cell", "area"])


def wall_steps(faces: DataFrame, members: DataFrame) -> DataFrame:
    """(face, left, entered, either) for faces (face, a, b) between two cells and the walls each cell lies in (cell, walls array): the walls one leaves and enters by going from a to b,
    and all that either lies in; arrays are sorted, a cell without a row, or outside (-1), lies in none."""
    kind = dict(members.dtypes)["walls"]
    side = lambda c: members.select(F.col("cell").alias(c), F.col("walls").alias(f"w{c}"))
    j = faces.select("face", "a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    a, b = (F.coalesce(f"w{c}", F.array().cast(kind)) for c in "ab")
    return j.select("face", F.sort_array(F.array_except(a, b)).alias("left"), F.sort_array(F.array_except(b, a)).alias("entered"), F.sort_array(F.array_union(a, b)).alias("either"))
