"""Windows on walls: wall candidates from a mesh, instances matched to walls, outlines in the wall's plane, placed as building components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows
from plumbline.operators import geometry, matching
from plumbline.operators.components import components
from plumbline.operators.instances import face_normals
from plumbline.session import stage

#: Triangles a placement test holds in every task at once.
MOST_TRIANGLES = 500_000


def planar_regions(vertices: DataFrame, faces: DataFrame, angle_deg: float = 5.0, distance: float = 0.05) -> DataFrame:
    """(face, region): faces joined over shared edges while they are coplanar."""
    n = stage(face_normals(vertices, faces))
    edge = F.expr("transform(sequence(0, size(verts) - 1), i -> struct(least(verts[i], verts[(i + 1) % size(verts)]) as u, greatest(verts[i], verts[(i + 1) % size(verts)]) as v))")
    e = faces.select("face", F.explode(edge).alias("e")).select("face", "e.u", "e.v")
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, (F.col("a.u") == F.col("b.u")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.face") < F.col("b.face"))).select(F.col("a.face").alias("a"), F.col("b.face").alias("b"))
    left, right = n.select(F.col("face").alias("a"), *(F.col(c).alias(f"a_{c}") for c in n.columns[1:])), n.select(F.col("face").alias("b"), *(F.col(c).alias(f"b_{c}") for c in n.columns[1:]))
    dot = sum(F.col(f"a_n{c}") * F.col(f"b_n{c}") for c in "xyz")
    off = F.abs(sum(F.col(f"a_n{c}") * (F.col(f"b_{c}") - F.col(f"a_{c}")) for c in "xyz"))
    c = components(j.join(left, "a").join(right, "b").where((dot >= float(np.cos(np.radians(angle_deg)))) & (off <= distance)).select("a", "b"))
    return faces.select("face").join(c, faces.face == c.node, "left").select("face", F.coalesce("component", "face").alias("region"))


def region_outlines(vertices: DataFrame, faces: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, loop, k, v): boundary loops of each region. A boundary half-edge has no opposite in its region; each loop is walked from its smallest vertex."""
    half = F.expr("transform(sequence(0, size(verts) - 1), i -> struct(verts[i] as u, verts[(i + 1) % size(verts)] as v))")
    h = faces.join(regions, "face").select("region", F.explode(half).alias("h")).select("region", "h.u", "h.v")
    border = h.join(h.select("region", F.col("v").alias("u"), F.col("u").alias("v")), ["region", "u", "v"], "left_anti")

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        nxt: dict[int, list[int]] = {}
        for u, v in sorted(zip(f.u, f.v)):
            nxt.setdefault(u, []).append(v)
        out, loop = [], 0
        for start in sorted(nxt):
            while nxt.get(start):
                at, k = start, 0
                while nxt.get(at):
                    out.append((f.region.iloc[0], loop, k, at))
                    at, k = nxt[at].pop(0), k + 1
                    if at == start:
                        break
                loop += 1
        return pd.DataFrame(out, columns=["region", "loop", "k", "v"])

    kind = dict(regions.dtypes)["region"]
    return border.groupBy("region").applyInPandas(walk, f"region {kind}, loop int, k int, v long")


def wall_candidates(vertices: DataFrame, faces: DataFrame, least_area: float = 1.0, eps: float = 0.1) -> DataFrame:
    """(wall_id, a, b, c, d, x, y, z, area): upright planar regions that are large enough, with area-weighted normal and centre."""
    regions = stage(planar_regions(vertices, faces))
    m = geometry.region_means(face_normals(vertices, faces).join(regions, "face"))
    m = m.where((F.abs("nz") < eps) & (F.col("area") >= least_area))
    return m.select(F.col("region").alias("wall_id"), F.col("nx").alias("a"), F.col("ny").alias("b"), F.col("nz").alias("c"), (-(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z"))).alias("d"), "x", "y", "z", "area")


def instance_planes(points: DataFrame) -> DataFrame:
    """(instance_id, nx, ny, nz, x, y, z, flatness) of points (instance, x, y, z): normal of least variance, centre, and how flat the instance is (1 for a plane)."""
    pairs = [(u, v) for i, u in enumerate("xyz") for v in "xyz"[i:]]
    g = points.where("instance > 0").groupBy("instance").agg(*(F.avg(u).alias(u) for u in "xyz"), *(F.covar_pop(u, v).alias(u + v) for u, v in pairs))

    def solve(parts):
        for f in parts:
            m = np.array([[f[min(u, v) + max(u, v)] for v in "xyz"] for u in "xyz"], float).transpose(2, 0, 1) if len(f) else np.zeros((0, 3, 3))
            values, vectors = np.linalg.eigh(m)
            n, total = vectors[:, :, 0], values.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                flat = np.where(total > 0, 1 - 3 * np.maximum(values[:, 0], 0) / total, 1.0)
            yield pd.DataFrame({"instance_id": f.instance, "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "x": f.x, "y": f.y, "z": f.z, "flatness": flat})

    return g.mapInPandas(solve, "instance_id long, nx double, ny double, nz double, x double, y double, z double, flatness double")


def create_windows(points: DataFrame, walls: DataFrame, offset: float = 0.0, rectangle: bool = True) -> tuple[DataFrame, DataFrame]:
    """(windows, unmatched): per instance of points (point_idx, instance, x, y, z) its outline on the wall it fits best, pushed off the wall's plane by `offset` along its normal. Windows are
    (instance_id, wall_id, name, boundary array<struct<x,y,z>>, width, height); a rectangle, or the convex hull in the wall's plane. Instances no wall suits are in `unmatched`."""
    m = stage(matching.cheapest_wall(instance_planes(points), walls))
    p = points.where("instance > 0").select(F.col("instance").alias("instance_id"), "x", "y", "z").join(m.where("wall_id is not null").select("instance_id", "wall_id"), "instance_id")
    p = p.join(walls.select("wall_id", "a", "b", "c", "d"), "wall_id")
    # u runs level along the wall, v upwards in it
    size = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2)
    ux, uy = -F.col("b") / size, F.col("a") / size
    p = p.withColumns({"ux": ux, "uy": uy}).withColumns({"vx": -F.col("c") * F.col("uy") * -1, "vy": F.col("c") * F.col("ux") * -1, "vz": F.col("a") * F.col("uy") - F.col("b") * F.col("ux")})
    p = p.withColumns({"u": F.col("x") * F.col("ux") + F.col("y") * F.col("uy"), "v": F.col("x") * F.col("vx") + F.col("y") * F.col("vy") + F.col("z") * F.col("vz")})
    frame = ["a", "b", "c", "d", "ux", "uy", "vx", "vy", "vz"]
    g = p.groupBy("instance_id", "wall_id", *frame)
    at = lambda u, v: F.struct(*((u * F.col(f"u{k}") + v * F.col(f"v{k}") + (offset - F.col("d")) * F.col(n) if k != "z" else v * F.col("vz") + (offset - F.col("d")) * F.col(n)).alias(k) for k, n in zip("xyz", "abc")))
    if rectangle:
        w = g.agg(*(f(c).alias(f"{n}{c}") for c in "uv" for n, f in (("lo", F.min), ("hi", F.max))))
        ring = F.array(*(at(F.col(u), F.col(v)) for u, v in (("lou", "lov"), ("hiu", "lov"), ("hiu", "hiv"), ("lou", "hiv"))))
        w = w.select("instance_id", "wall_id", ring.alias("boundary"), (F.col("hiu") - F.col("lou")).alias("width"), (F.col("hiv") - F.col("lov")).alias("height"))
    else:
        # hull candidates only: the extreme points of 720 directions, so a large instance is not gathered
        turn = p.select("instance_id", "wall_id", *frame, "u", "v", F.explode(F.sequence(F.lit(0), F.lit(719))).alias("k"))
        far = F.col("u") * F.cos(F.col("k") * (2 * np.pi / 720)) + F.col("v") * F.sin(F.col("k") * (2 * np.pi / 720))
        best = turn.groupBy("instance_id", "wall_id", *frame, "k").agg(F.max(F.struct(far.alias("far"), "u", "v")).alias("m"))
        r = best.groupBy("instance_id", "wall_id", *frame).agg(F.array_sort(F.collect_list(F.struct("k", F.col("m.u").alias("u"), F.col("m.v").alias("v")))).alias("ring"))
        ring = F.array_distinct(F.transform("ring", lambda s: at(s["u"], s["v"])))
        spread = lambda c: F.array_max(F.transform("ring", lambda s: s[c])) - F.array_min(F.transform("ring", lambda s: s[c]))
        w = r.select("instance_id", "wall_id", ring.alias("boundary"), spread("u").alias("width"), spread("v").alias("height"))
    windows = number_rows(w, "instance_id").withColumn("name", F.concat(F.lit("window_"), "rn"))
    return windows.select("instance_id", "wall_id", "name", "boundary", "width", "height"), m.where("wall_id is null").select("instance_id")


def placement(corners: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(window, placement) of outlines (window, x, y, z per corner): inside, outside or mixed, by whether rays from the corners leave the closed mesh (triangles) more often than they enter it."""
    t = stage(faces.select("face", F.posexplode("verts").alias("k", "v")).join(vertices, "v").groupBy("face").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "z"))).alias("c")))
    blocks = max(1, -(-t.count() // MOST_TRIANGLES))
    kind = dict(corners.dtypes)["window"]
    votes = None
    for k in range(blocks):  # what a ray crosses adds up over the blocks of triangles
        part = t if blocks == 1 else t.where(F.pmod(F.xxhash64("face"), F.lit(blocks)) == k)
        tri = np.array([[[p["x"], p["y"], p["z"]] for p in r["c"][:3]] for r in part.collect()], float).reshape(-1, 3, 3)
        one = corners.select("window", "x", "y", "z").mapInPandas(_crossings(corners.sparkSession.sparkContext.broadcast(tri)), f"window {kind}, x double, y double, z double, more long")
        votes = one if votes is None else votes.unionByName(one)
    v = votes.groupBy("window", "x", "y", "z").agg((F.sum("more") > 0).alias("inside"))
    return v.groupBy("window").agg(F.when(F.every("inside"), "inside").when(~F.some("inside"), "outside").otherwise("mixed").alias("placement"))


def _crossings(sent):
    """Per corner by how many more triangles its rays leave through than enter."""
    rays = np.array([[0.57, 0.61, 0.55], [-0.61, 0.33, 0.72], [0.29, -0.84, -0.46]])

    def run(parts):
        tri = sent.value
        e1, e2 = tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
        for f in parts:
            votes = []
            for p in f[["x", "y", "z"]].to_numpy(float):
                back = front = 0
                for d in rays:
                    h = np.cross(d, e2)
                    det = (e1 * h).sum(axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = p - tri[:, 0]
                        u = (s * h).sum(axis=1) / det
                        q = np.cross(s, e1)
                        v = (q @ d) / det
                        r = (q * e2).sum(axis=1) / det
                    hit = (np.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (r > 1e-9)
                    # the normal along the ray: the face is left through its back
                    back += int((hit & (det < 0)).sum())
                    front += int((hit & (det > 0)).sum())
                votes.append(back - front)
            yield f.assign(more=np.array(votes, np.int64))

    return run
