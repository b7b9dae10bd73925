"""The stages of a building's project, each composed of the library's operators: clouds, planes, rooms, instances, mesh, windows, texture, dense clouds, refined poses.

A project is a folder of parquet tables: `<table>.parquet` as in the survey's catalogue, `cloud_<name>.parquet` per cloud (rows by
point_idx: coordinates and colour, normals, or labels) and `mesh_<name>_vertices.parquet`, `mesh_<name>_faces.parquet` per
mesh. A stage first checks what it needs, writes its results whole or not at all, and keeps the log.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows
from plumbline.operators import cells, geometry, images, instances, planes, registration, rooms, spatial, store, voxel, windows
from plumbline.plans.labels import compile_filter, select_points
from plumbline.session import stage

#: Planes, pairs and faces of one building that the cell complex is built of on the driver.
MOST_PLANES = 2_000
#: Points below which a filter is worth a warning.
FEW = 100
LOG = "id long, stage string, started_at timestamp, finished_at timestamp, parameters string, status string, error_msg string"


class NotReady(ValueError):
    """What a stage needs isn't there."""


class Project:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _there(self, name: str) -> bool:
        p = self.fs_path(f"{self.folder}/{name}.parquet")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def names(self) -> list[str]:
        p = self.fs_path(self.folder)
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
        return sorted(f.getPath().getName().removesuffix(".parquet") for f in found if f.getPath().getName().endswith(".parquet"))

    def table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet") if self._there(name) else None

    def save(self, name: str, rows: DataFrame) -> None:
        store.replace(rows, f"{self.folder}/{name}.parquet")

    def cloud(self, name: str) -> DataFrame | None:
        return self.table(f"cloud_{name}")

    def save_cloud(self, name: str, rows: DataFrame) -> None:
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"{name!r} is no name of a cloud")
        self.save(f"cloud_{name}", rows)

    def save_labels(self, name: str, labels: DataFrame, names: dict[int, str] | None = None) -> None:
        """A row-aligned label cloud, and the names of its labels."""
        self.save_cloud(name, labels.select("point_idx", F.col(labels.columns[1]).cast("long").alias("label")))
        if names:
            new = self.spark.createDataFrame([(name, int(k), v) for k, v in names.items()], "cloud_name string, label_id int, name string")
            old = self.table("label_names")
            self.save("label_names", new if old is None else stage(old.where(F.col("cloud_name") != name).unionByName(new)))

    def mesh(self, name: str = "mesh") -> tuple[DataFrame, DataFrame] | None:
        v, f = self.table(f"mesh_{name}_vertices"), self.table(f"mesh_{name}_faces")
        return None if v is None or f is None else (v, f)

    def save_mesh(self, name: str, vertices: DataFrame, faces: DataFrame) -> None:
        v, f = stage(vertices), stage(faces)
        n, m = v.count(), f.count()
        row = self.spark.createDataFrame([(name, "ply_binary", n, m)], "name string, format string, vertex_count long, face_count long")
        tables = {} if self.table("meshes") is None else {"meshes": self.table("meshes")}
        self.save("meshes", stage(store.save_mesh(tables, row)["meshes"]))
        self.save(f"mesh_{name}_vertices", v)
        self.save(f"mesh_{name}_faces", f)

    def run(self, name: str, work: Callable[[], object], **parameters) -> object:
        """Do a stage between its log entries; one that fails is marked with its error."""
        log, at = store.log_start(self.table("pipeline_log") if self._there("pipeline_log") else self.spark.createDataFrame([], LOG), name, json.dumps(parameters, default=str))
        self.save("pipeline_log", stage(log))
        try:
            out = work()
        except Exception as e:
            self.save("pipeline_log", stage(store.log_end(self.table("pipeline_log"), at, "failed", str(e)[:1_000])))
            raise
        self.save("pipeline_log", stage(store.log_end(self.table("pipeline_log"), at)))
        return out


# ---- what stages need

#: The clouds and tables each stage needs, those of them that must have as many rows as each other, and the stage that makes them.
NEEDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "clouds": (("sensor_frames",), ()),
    "annotate": (("sensor_frames",), ()),
    "planes": (("cloud_cloud", "cloud_normals"), ("cloud", "normals")),
    "rooms": (("cloud_cloud", "cloud_planes", "cloud_plane_centroids", "cloud_plane_normals"), ("cloud", "planes")),
    "instances": (("cloud_cloud", "cloud_labels"), ("cloud", "labels")),
    "project": (("cloud_cloud", "sensor_frames", "segmentation_images"), ()),
    "mesh": (("cloud_cloud", "cloud_normals", "cloud_rooms", "cloud_planes", "cloud_plane_centroids", "cloud_plane_normals"), ("cloud", "normals", "rooms", "planes")),
    "windows": (("mesh_mesh_vertices", "cloud_cloud", "cloud_instances"), ("cloud", "instances")),
    "texture": (("mesh_mesh_vertices", "cloud_cloud"), ()),
    "dense": (("cloud_dense",), ()),
    "register": (("sensor_frames",), ()),
}
MADE_BY = {"cloud_cloud": "create clouds", "cloud_normals": "create clouds", "cloud_labels": "create project", "cloud_planes": "create planes", "cloud_plane_centroids": "create planes", "cloud_plane_normals": "create planes",
           "cloud_rooms": "create rooms", "cloud_instances": "create instances", "mesh_mesh_vertices": "create mesh", "sensor_frames": "import rtabmap", "segmentation_images": "create annotate", "cloud_dense": "import ply"}


def preflight(p: Project, name: str, **instead: str) -> None:
    """NotReady with what is missing for a stage and what makes it; clouds that must be row-aligned are counted. `instead` renames needed clouds (`labels="other"`)."""
    needs, aligned = NEEDS[name]
    as_ = lambda n: f"cloud_{instead[n.removeprefix('cloud_')]}" if n.removeprefix("cloud_") in instead else n
    missing = [n for n in needs if not p._there(as_(n))]
    if missing:
        steps = list(dict.fromkeys(MADE_BY[n] for n in missing))
        raise NotReady(f"{name} needs {', '.join(as_(n).removeprefix('cloud_') for n in missing)}; first: {', then '.join(steps)}")
    if aligned:
        sizes = {n: p.cloud(instead.get(n, n)).count() for n in aligned}
        if len(set(sizes.values())) > 1:
            raise NotReady("clouds differ in size: " + ", ".join(f"{n}={k}" for n, k in sizes.items()))
    if name == "register":
        frames = p.table("sensor_frames")
        if frames.where("length(depth) > 0").limit(2).count() < 2:
            raise NotReady("two frames with depth are needed")


def selected(p: Project, text: str | None, base: str = "cloud") -> DataFrame | None:
    """The point_idx a label filter keeps, None for no filter. Clouds named in it must be as large as the base cloud."""
    if not text:
        return None
    clouds = {n.removeprefix("cloud_"): p.table(n) for n in p.names() if n.startswith("cloud_")}
    labels = {n: c for n, c in clouds.items() if "label" in c.columns}
    names = compile_filter(text).names
    size = clouds[base].count()
    for n in names:
        if n in labels and labels[n].count() != size:
            raise NotReady(f"cloud {n} isn't as large as {base}")
    got = stage(select_points(text, labels))
    n = got.count()
    if n < FEW:
        warnings.warn(f"the filter keeps {n} points" if n else "the filter keeps no point", stacklevel=2)
    return got


# ---- stages


def create_clouds(p: Project, grid: float = 0.05, least: float = 0.0, most: float = 4.0, step: int = 4, confidence: int = 2, neighbours: int = 50, factor: float = 1.0, radius: float | None = None, enough: int = 5) -> dict[str, int]:
    """Frames to one cloud with normals and labels: depth filters, back-projection, voxel means, normals, a vote of the label pixels around each point, statistical and radius outliers. Labels come from `label_pixels`
    (node_id, u, v, label) where it is there."""
    preflight(p, "clouds")
    f = p.table("sensor_frames")
    kept = images.filter_depth(f).select("node_id", "width", "height", "depth", "conf").join(f.drop("width", "height", "depth", "conf"), "node_id")
    w = stage(images.world_points(kept, least, most, confidence, step))
    raw = number_rows(w, "node_id", "v", "u", name="point_idx", start=0)
    v = voxel.voxel_centroid(raw, grid)
    c = stage(number_rows(v.select("first", "x", "y", "z"), "first", name="point_idx", start=0).select("point_idx", "x", "y", "z"))
    n = stage(spatial.pca_normals(c, radius or 3 * grid).where(voxel.finite("nx", "ny", "nz")))
    c = c.join(n.select("point_idx"), "point_idx", "left_semi")
    keep = spatial.statistical_outliers(c, neighbours, factor).where("keep").select("point_idx").join(spatial.radius_outliers(c, radius or 3 * grid, enough).where("keep").select("point_idx"), "point_idx")
    c = stage(number_rows(c.join(keep, "point_idx", "left_semi"), "point_idx", name="at", start=0))
    cloud = c.select(F.col("at").alias("point_idx"), "x", "y", "z", *(F.lit(0).cast("short").alias(k) for k in "rgb"))
    p.save_cloud("cloud", cloud)
    p.save_cloud("normals", n.join(c.select("point_idx", "at"), "point_idx").select(F.col("at").alias("point_idx"), "nx", "ny", "nz", "curvature"))
    pixels = p.table("label_pixels")
    if pixels is not None:
        voters = number_rows(w.join(pixels, ["node_id", "u", "v"]).where("label >= 0"), "node_id", "v", "u", name="point_idx", start=0)
        names = p.table("pipeline_log")
        last = names.where("stage = 'annotate' and status = 'success'").orderBy(F.desc("id")).select("parameters").first() if names is not None else None
        classes = {int(k): str(v) for k, v in json.loads(last[0]).get("classes", {}).items()} if last else None
        p.save_labels("labels", spatial.majority_vote(cloud, voters, radius or 3 * grid), classes)
    return {"frames": f.count(), "points": cloud.count()}


def create_planes(p: Project, where: str | None = None, angle: float = 25.0, distance: float = 0.07, least: int = 1000, radius: float = 0.5) -> int:
    """Planes grown over the cloud (or the points a filter keeps): labels `planes`, and a centroid and normal per plane in the order of labels."""
    preflight(p, "planes")
    all_ = p.cloud("cloud").select("point_idx", "x", "y", "z").join(p.cloud("normals"), "point_idx")
    few = selected(p, where)
    part = all_ if few is None else all_.join(few, "point_idx", "left_semi")
    got = stage(planes.grow_regions(part.withColumn("cloud", F.lit(0)), angle, distance, least, radius).select("point_idx", "plane"))
    labels = stage(all_.select("point_idx").join(got, "point_idx", "left").select("point_idx", F.coalesce("plane", F.lit(0)).alias("label")))
    fit = stage(planes.refit_planes(all_.join(got, "point_idx")))
    p.save_labels("planes", labels)
    p.save_cloud("plane_centroids", fit.select(F.col("plane").alias("point_idx"), "x", "y", "z"))
    p.save_cloud("plane_normals", fit.select(F.col("plane").alias("point_idx"), F.col("a").alias("nx"), F.col("b").alias("ny"), F.col("c").alias("nz"), F.lit(0.0).alias("curvature")))
    return fit.count()


def create_rooms(p: Project, where: str | None = None, grid: float = 0.5, resolution: float = 1.0) -> int:
    """Rooms by what surfaces see of each other; points the filter leaves out, or without a plane, are -1."""
    preflight(p, "rooms")
    all_ = p.cloud("cloud").select("point_idx", "x", "y", "z").join(p.cloud("normals").select("point_idx", "nx", "ny", "nz"), "point_idx").join(p.cloud("planes"), "point_idx")
    few = selected(p, where)
    part = stage(all_ if few is None else all_.join(few, "point_idx", "left_semi"))
    got = rooms.segment_rooms(part, grid, resolution)
    out = stage(all_.select("point_idx").join(got, "point_idx", "left").select("point_idx", F.coalesce("room", F.lit(-1)).alias("label")))
    p.save_labels("rooms", out)
    return out.where("label >= 0").select("label").distinct().count()


def create_instances(p: Project, labels: str = "labels", tolerance: float = 0.5, least: int = 50, most: int = 1_000_000, only: Iterable[int] | None = None) -> int:
    """Instances of a semantic label cloud, with their names."""
    preflight(p, "instances", labels=labels)
    c = p.cloud("cloud").select("point_idx", "x", "y", "z").join(p.cloud(labels), "point_idx")
    got = stage(instances.instances(c, tolerance, least, most, list(only) if only else None))
    found = got.where("instance > 0").groupBy("instance", "label").agg(F.count("*").alias("n")).collect()  # one row per instance of a building
    p.save_labels("instances", got.select("point_idx", "instance"), {r["instance"]: f"SM{r['label']}-{r['instance']} ({r['n']}p)" for r in found})
    return len(found)


def project_labels(p: Project) -> int:
    """Labels of the pixels (`label_pixels`) each point of the cloud is seen at, as the cloud `labels`."""
    preflight(p, "project")
    f = p.table("sensor_frames")
    view = F.udf(_view, "array<double>")  # one 4x4 inverse per frame
    frames = f.select("node_id", view("pose", "local").alias("view"), "fx", "fy", "cx", "cy", "width", "height")
    out = stage(images.project_labels(p.cloud("cloud"), frames, p.table("label_pixels")))
    p.save_labels("labels", out)
    return out.where("label <> 0").count()


def _view(pose, local) -> list[float]:
    return np.linalg.inv(np.array(pose).reshape(4, 4) @ np.array(local).reshape(4, 4))[:3].ravel().tolist()


def merged_planes(points: DataFrame, fitted: list[dict], angle: float = 0.1, overlap: float = 0.8, threshold: float = 0.5) -> list[dict]:
    """Planes {id, n, d, c, points} merged greedily in order, as `geometry.merge_planes` does, without their points: how many points of each plane lie on each
    other one of like normal is counted in Spark, and a merged plane is the mean of its parts by number of points."""
    spark = points.sparkSession
    rows = [(p["id"], *map(float, p["n"]), float(p["d"])) for p in fitted]
    t = F.broadcast(spark.createDataFrame(rows, "other long, a double, b double, c double, d double"))  # at most MOST_PLANES rows
    like = spark.createDataFrame([(p["id"], q["id"]) for p in fitted for q in fitted if p["id"] != q["id"] and abs(p["n"] @ q["n"] - 1) <= angle] or [(-1, -1)], "plane long, other long")
    on = points.where("plane > 0").join(F.broadcast(like), "plane").join(t, "other").where(F.abs(geometry.plane_distance()) < threshold).groupBy("plane", "other").agg(F.count("*").alias("n"))
    count = {(r["plane"], r["other"]): r["n"] for r in on.collect()}
    out: list[dict] = []
    for p in fitted:
        for q in out:
            both = count.get((p["id"], q["ids"][0]), 0) + count.get((q["ids"][0], p["id"]), 0)
            if abs(p["n"] @ q["n"] - 1) <= angle and both / (p["points"] + q["first"]) >= overlap:
                w = q["points"] + p["points"]
                q["c"] = (q["c"] * q["points"] + p["c"] * p["points"]) / w
                n = q["n"] * q["points"] + p["n"] * p["points"]
                q["n"], q["points"], q["ids"] = n / np.linalg.norm(n), w, [*q["ids"], p["id"]]
                q["d"] = -float(q["n"] @ q["c"])
                break
        else:
            out.append(dict(p, ids=[p["id"]], first=p["points"]))
    return out


def create_mesh(p: Project, search: float = 0.6, offset: float = 0.5, where: str | None = None, rays: int = 100, alpha: float = 0.04) -> dict[str, int]:
    """The closed surface of a building's rooms: planes regularised, merged, made upright or level and paired; the cell complex of wall lines and floors; room probabilities of cells by rays, coverage of faces by points; cells labelled;
    the faces between inside and outside."""
    preflight(p, "mesh")
    c = p.cloud("cloud").select("point_idx", "x", "y", "z").join(p.cloud("planes").select("point_idx", F.col("label").alias("plane")), "point_idx")
    few = selected(p, where)
    c = stage(c if few is None else c.join(few, "point_idx", "left_semi"))
    normal = {r["point_idx"]: np.array([r["nx"], r["ny"], r["nz"]]) for r in p.cloud("plane_normals").limit(MOST_PLANES + 1).collect()}
    if len(normal) > MOST_PLANES:
        raise ValueError(f"more than {MOST_PLANES} planes in one building")
    means = c.where("plane > 0").groupBy("plane").agg(*(F.avg(a).alias(a) for a in "xyz"), F.count("*").alias("n")).orderBy("plane").collect()
    if not means:
        raise NotReady("no point lies on a plane")
    # normals into the room: as those of the points are
    own = c.join(p.cloud("normals").select("point_idx", "nx", "ny", "nz"), "point_idx").where("plane > 0").groupBy("plane").agg(*(F.avg(f"n{a}").alias(f"n{a}") for a in "xyz"))
    facing = {r["plane"]: np.array([r["nx"], r["ny"], r["nz"]]) for r in own.collect()}
    turned = [normal[r["plane"]] * (1 if normal[r["plane"]] @ facing[r["plane"]] >= 0 else -1) for r in means]
    regular = geometry.regularise(np.array(turned), 10.0)
    fitted = [{"id": r["plane"], "n": n, "c": (m := np.array([r["x"], r["y"], r["z"]])), "d": -float(n @ m), "points": r["n"]} for r, n in zip(means, regular)]
    merged = merged_planes(c, fitted)
    for q in merged:  # upright or level where nearly so
        n = q["n"].copy()
        if abs(n[2]) < 0.1:
            n[2] = 0
        elif abs(n[2]) > 0.9:
            n[:2] = 0
        q["n"] = n / np.linalg.norm(n)
        q["d"] = -float(q["n"] @ q["c"])
    upright = [q for q in merged if q["n"][2] == 0]
    level = [q for q in merged if q["n"][0] == q["n"][1] == 0]
    if not upright or len({round(-q["d"] * q["n"][2], 3) for q in level}) < 2:
        raise NotReady("a mesh needs upright planes and two floors")
    pairs = geometry.pair_planes(upright, search, offset)
    lines = sorted({tuple(round(float(x), 6) for x in ((q["n"][0], q["n"][1], q["d"]) if (q["n"][0], q["n"][1]) > (0, 0) else (-q["n"][0], -q["n"][1], -q["d"]))) for pair in pairs for q in pair})
    heights = [round(float(-q["d"] * q["n"][2]), 6) for q in level]
    b = c.agg(*(f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cc, faces = cells.complex_of(lines, heights, (b["lox"], b["loy"], b["hix"], b["hiy"]))
    spark = p.spark
    samples = voxel.uniform_sample(c.withColumn("label", F.col("plane")).where("plane > 0"), 0.5).select("point_idx").join(c, "point_idx").join(p.cloud("normals").select("point_idx", "nx", "ny", "nz"), "point_idx").join(p.cloud("rooms").select("point_idx", F.col("label").alias("room")), "point_idx").where("room >= 0")
    probability = {(r["cell"], r["room"]): r["p"] for r in cells.room_probabilities(spark.createDataFrame(cc[["cell", "x", "y", "z"]]), stage(samples), rays=rays).collect()}  # cells times rooms of one building
    coverage = _coverage(c, faces)
    n_rooms = max((r for _, r in probability), default=0)
    label = cells.label_cells(cc, faces, probability, coverage, n_rooms, alpha)
    members = cells.wall_membership(cc, [(q["n"], q["d"], r["n"], r["d"]) for q, r in pairs])
    p.save("cell_complex", spark.createDataFrame([(int(k), int(label[k]), [int(w) for w in sorted(members[k])]) for k in cc.cell], "cell long, room long, walls array<long>"))
    v, f = surface(faces, label)
    if not len(f):
        raise NotReady("no cell is inside a room")
    p.save_mesh("mesh", spark.createDataFrame(v), spark.createDataFrame(f))
    return {"planes": len(merged), "pairs": len(pairs), "cells": len(cc), "faces": len(f)}


def _coverage(points: DataFrame, faces: pd.DataFrame, step: float = 0.2, near: float = 0.25) -> dict[int, float]:
    """The covered share of each face of the complex, by the points near its rectangle (faces of other shape: of their bounding one)."""
    rows = []
    for r in faces.itertuples():
        ring = np.array(r.ring, float)
        e = ring[1] - ring[0]
        size = np.linalg.norm(e)
        if size < 1e-9:
            continue
        u = e / size
        n = np.cross(u, ring[2] - ring[0])
        if np.linalg.norm(n) < 1e-9:
            continue
        n /= np.linalg.norm(n)
        v = np.cross(n, u)
        q = ring - ring[0]
        lo = (q @ u).min(), (q @ v).min()
        o = ring[0] + lo[0] * u + lo[1] * v
        rows.append((int(r.face), *map(float, n), -float(n @ o), *map(float, u), *map(float, v), -float(u @ o), -float(v @ o), int(np.ceil(np.ptp(q @ u) / step)), int(np.ceil(np.ptp(q @ v) / step))))
    names = "face long, a double, b double, c double, d double, ux double, uy double, uz double, vx double, vy double, vz double, ou double, ov double, nu int, nv int"
    t = points.sparkSession.createDataFrame(rows, names)
    at = lambda k: sum(F.col(f"{k}{a}") * F.col(a) for a in "xyz") + F.col(f"o{k}")
    hit = points.select("x", "y", "z").join(F.broadcast(t), F.abs(geometry.plane_distance()) <= near).select("face", at("u").alias("u"), at("v").alias("v"), "nu", "nv")
    hit = hit.where((F.col("u") > -step) & (F.col("v") > -step) & (F.col("u") < (F.col("nu") + 1) * step) & (F.col("v") < (F.col("nv") + 1) * step))
    return {r["face"]: r["coverage"] for r in cells.face_coverage(hit.select("face", "u", "v"), t.select("face", "nu", "nv"), step).collect()}


def surface(faces: pd.DataFrame, label: dict[int, int]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Vertices (v, x, y, z) and triangles (face, verts) of the faces between inside and outside, seen from outside counter-clockwise."""
    at: dict[tuple, int] = {}
    tri: list[list[int]] = []
    out = cells.boundary_faces(faces, label)
    ring = dict(zip(faces.face, faces.ring))
    centre = dict(zip(faces.face, faces.a_centre))
    first = dict(zip(faces.face, faces.a))
    for r in out.itertuples():
        pts = [tuple(round(float(x), 9) for x in q) for q in ring[r.face]]
        a = np.array(pts)
        n = np.cross(a[1] - a[0], a[2] - a[1])
        outward = float(n @ (a.mean(axis=0) - np.array(centre[r.face]))) * (1 if first[r.face] == r.cell else -1)
        ids = [at.setdefault(q, len(at)) for q in (pts if outward >= 0 else pts[::-1])]
        tri += [[ids[0], ids[i], ids[i + 1]] for i in range(1, len(ids) - 1)]
    return pd.DataFrame([(i, *q) for q, i in at.items()], columns=["v", "x", "y", "z"]), pd.DataFrame({"face": range(len(tri)), "verts": tri})


def create_windows(p: Project, offset: float = 0.0, rectangle: bool = True, labels: Iterable[int] | None = None, include_internal: bool = False, clear: bool = False) -> int:
    """Windows on the mesh's walls, one per instance (of the wanted classes), as building components; those inside the building are left out unless wanted."""
    preflight(p, "windows")
    v, f = p.mesh()
    c = p.cloud("cloud").select("point_idx", "x", "y", "z").join(p.cloud("instances").select("point_idx", F.col("label").alias("instance")), "point_idx")
    names = p.table("label_names")
    if labels is not None and names is not None:
        good = names.where("cloud_name = 'instances'").select(F.col("label_id").cast("long").alias("instance"), F.regexp_extract("name", r"SM(\d+)-", 1).cast("int").alias("k")).where(F.col("k").isin(list(labels)))
        c = c.join(good.select("instance"), "instance", "left_semi")
    got, _ = windows.create_windows(c, windows.wall_candidates(v, f), offset, rectangle)
    got = stage(got)
    corners = got.select(F.col("name").alias("window"), F.explode("boundary").alias("q")).select("window", "q.x", "q.y", "q.z")
    side = stage(windows.placement(corners, v, f))
    keep = got.join(side, got.name == side.window, "left").where(F.lit(include_internal) | F.coalesce(F.col("placement") != "inside", F.lit(True)))
    new = stage(keep.select("name", F.lit("window").alias("type"), "boundary", F.col("wall_id").cast("string").alias("parent"), "placement"))
    old = p.table("building_components")
    p.save("building_components", new if old is None or clear else stage(store.upsert(old, new, ["name"])))
    return new.count()


def create_dense(p: Project, source: str = "dense", seed: str | None = None, neighbours: int = 50, factor: float = 1.0, margin: float = 0.0) -> int:
    """A dense cloud clipped to the percentile box of a seed cloud and rid of statistical outliers, as the cloud `cloud`."""
    preflight(p, "dense", dense=source)
    c = p.cloud(source)
    c = stage(voxel.percentile_clip(c, p.cloud(seed), margin=margin) if seed else c)
    keep = spatial.statistical_outliers(c, neighbours, factor).where("keep").select("point_idx")
    out = stage(number_rows(c.join(keep, "point_idx", "left_semi"), "point_idx", name="at", start=0).drop("point_idx").withColumnRenamed("at", "point_idx"))
    p.save_cloud("cloud", out)
    return out.count()


def downsample(p: Project, leaf: float, aligned: dict[str, str] | None = None, name: str = "cloud", out: str | None = None) -> int:
    """A cloud thinned to one point per voxel, and row-aligned clouds with it (name: name of the result): the mean of normals, the commonest label."""
    c = p.cloud(name)
    if c is None:
        raise NotReady(f"no cloud {name}")
    colours = tuple(k for k in "rgb" if k in c.columns)
    a = stage(voxel.voxel_assign(c, leaf))
    n = c.count()
    results = {out or name: a.join(c, "point_idx").groupBy(F.col("bucket").alias("point_idx")).agg(*(F.avg(F.col(k).cast("double")).alias(k) for k in "xyz"), *(F.round(F.avg(k)).cast("short").alias(k) for k in colours))}
    for k, to in (aligned or {}).items():
        t = p.cloud(k)
        if t is None or t.count() != n:
            raise NotReady(f"cloud {k} isn't aligned with {name}")
        if "nx" in t.columns:
            results[to] = voxel.voxel_normals(t, a).withColumnRenamed("bucket", "point_idx")
        else:
            votes = a.join(t, "point_idx").groupBy("bucket", "label").agg(F.count("*").alias("n"))
            results[to] = votes.groupBy(F.col("bucket").alias("point_idx")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("point_idx", "m.label")
    staged = {k: stage(r) for k, r in results.items()}  # nothing is put in place before all are worked out
    for k, r in staged.items():
        p.save_cloud(k, r)
    return staged[out or name].count()


def register(p: Project, window: int = 5, step: int = 4, rounds: int = 10, dry_run: bool = False, radius: float = 0.2, **matching: float) -> dict[str, float]:
    """Refined poses of the frames; unless it is a dry run they are written back as world pose times the inverse of the local transform."""
    preflight(p, "register")
    f = p.table("sensor_frames").where("length(depth) > 0 and pose is not null")
    s = stage(images.surfels(f, step))
    flat = number_rows(s, "node_id", "v", "u", name="point_idx", start=0)
    n = _frame_normals(flat, radius)
    surfels = stage(flat.join(n, "point_idx").select("node_id", "point_idx", "x", "y", "z", "nx", "ny", "nz"))
    meta = f.join(surfels.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "pose", "local").limit(registration.MOST_FRAMES + 1).collect()
    local = {r["node_id"]: np.array(r["local"]).reshape(4, 4) for r in meta}
    world = {r["node_id"]: np.array(r["pose"]).reshape(4, 4) @ local[r["node_id"]] for r in meta}
    if len(world) < 2:
        raise NotReady("fewer than two usable frames")
    ids = sorted(world)
    pairs = p.spark.createDataFrame([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 : i + 1 + window]], "a long, b long")
    poses, trace = registration.refine(surfels, pairs, world, rounds, **matching)
    if not dry_run:
        write_poses(p, poses, local)
    return {"frames": len(ids), "before": trace[0], "after": trace[-1]}


def _frame_normals(flat: DataFrame, radius: float) -> DataFrame:
    """Normals of the points of each frame among themselves, by moving the frames apart."""
    far = flat.agg(F.max(F.greatest(*(F.abs(a) for a in "xyz"))).alias("m")).first()["m"] or 1.0
    apart = flat.withColumn("x", F.col("x") + F.col("node_id") * F.lit(4 * far + 4 * radius))
    n = spatial.pca_normals(apart.select("point_idx", "x", "y", "z"), radius)
    return n.where(voxel.finite("nx", "ny", "nz")).select("point_idx", "nx", "ny", "nz")


def write_poses(p: Project, poses: dict[int, np.ndarray], local: dict[int, np.ndarray]) -> None:
    rows = [(int(k), [float(x) for x in (m @ np.linalg.inv(local[k])).ravel()]) for k, m in poses.items()]
    new = p.spark.createDataFrame(rows, "node_id long, new array<double>")
    f = p.table("sensor_frames")
    p.save("sensor_frames", stage(f.join(F.broadcast(new), "node_id", "left").withColumn("pose", F.coalesce("new", "pose")).select(*f.columns)))
