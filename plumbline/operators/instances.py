"""Instances: per class, the connected components of the graph of points within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows
from plumbline.operators.components import components
from plumbline.operators.spatial import kept
from plumbline.operators.voxel import AXES, finite
from plumbline.session import stage


def instances(points: DataFrame, tolerance: float = 0.5, least: int = 50, most: int = 1_000_000, labels: list[int] | None = None) -> DataFrame:
    """(point_idx, label, instance) of all points (point_idx, label, x, y, z): instances are numbered from 1 by label, then first point; 0
    where the label is 0 (or not wanted), or the cluster too small or too large. ValueError for a tolerance that isn't
    positive.

    Points in one cell of side tolerance/sqrt(3) are all within the tolerance, so the graph is one of cells: cells are
    linked if any two of their points are near enough. However dense a blob is, it gives few links."""
    if not tolerance > 0:
        raise ValueError("a tolerance must be positive")
    p = points.where((F.col("label") > 0) & finite(*AXES))
    if labels is not None:
        p = p.where(F.col("label").isin(labels))
    side = tolerance / 3**0.5 * (1 - 1e-12)
    p = p.select("point_idx", "label", *(F.col(a).cast("double").alias(a) for a in AXES), *(F.floor(F.col(a).cast("double") / F.lit(side)).cast("long").alias(f"c{a}") for a in AXES))
    first = p.groupBy("label", "cx", "cy", "cz").agg(F.min("point_idx").alias("cell"))
    p = stage(p.join(first, ["label", "cx", "cy", "cz"]))
    reach = F.sequence(F.lit(-2), F.lit(2))
    cells = first
    around = cells.select("label", F.col("cell").alias("from"), "cx", "cy", "cz")
    for a in AXES:
        around = around.withColumn("d", F.explode(reach)).withColumn(f"c{a}", F.col(f"c{a}") + F.col("d")).drop("d")
    pairs = kept(around, "label", "cx", "cy", "cz").join(kept(cells, "label", "cx", "cy", "cz"), ["label", "cx", "cy", "cz"]).where(F.col("from") < F.col("cell")).select(F.col("from").alias("a"), F.col("cell").alias("b"))
    left = p.select(F.col("cell").alias("a"), *(F.col(x).alias(f"a{x}") for x in AXES))
    right = p.select(F.col("cell").alias("b"), *(F.col(x).alias(f"b{x}") for x in AXES))
    d2 = sum((F.col(f"a{x}") - F.col(f"b{x}")) * (F.col(f"a{x}") - F.col(f"b{x}")) for x in AXES)
    links = kept(kept(pairs, "a").join(kept(left, "a"), "a"), "b").join(kept(right, "b"), "b").where(d2 <= tolerance * tolerance).select("a", "b").distinct()
    of = components(links).select(F.col("node").alias("cell"), "component")
    p = stage(p.join(of, "cell", "left").select("point_idx", "label", F.coalesce("component", "cell").alias("component")))
    sizes = p.groupBy("label", "component").agg(F.count("*").alias("n"), F.min("point_idx").alias("first")).where((F.col("n") >= least) & (F.col("n") <= most))
    numbered = number_rows(sizes, "label", "first", name="instance").select("component", "instance")
    got = p.join(numbered, "component").select("point_idx", "instance")
    return points.select("point_idx", "label").join(got, "point_idx", "left").select("point_idx", "label", F.coalesce("instance", F.lit(0)).cast("long").alias("instance"))


def mesh_parts(faces: DataFrame) -> DataFrame:
    """(face, part): connected components of faces (face, verts) that share a vertex; a part is its smallest vertex."""
    v = faces.select("face", F.explode("verts").alias("v"))
    links = v.groupBy("face").agg(F.min("v").alias("b")).join(v, "face").select(F.col("v").alias("a"), "b")
    c = components(links.where("a <> b"))
    f = v.groupBy("face").agg(F.min("v").alias("node"))
    return f.join(c, "node", "left").select("face", F.coalesce("component", "node").alias("part"))


def mesh_split(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (part, v, old, x, y, z) and faces (part, face, verts) of each part, vertices renumbered from 0 inside it."""
    from pyspark.sql import Window

    parts = stage(mesh_parts(faces))
    corner = faces.select("face", F.posexplode("verts").alias("k", "old")).join(parts, "face")
    used = corner.select("part", "old").distinct().withColumn("v", F.row_number().over(Window.partitionBy("part").orderBy("old")) - 1)
    new_faces = corner.join(used, ["part", "old"]).groupBy("part", "face").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("verts"))
    return used.join(vertices.withColumnRenamed("v", "old"), "old").select("part", "v", "old", "x", "y", "z"), new_faces


def unweld(vertices: DataFrame, faces: DataFrame, angle: float = 0.7854) -> tuple[DataFrame, DataFrame]:
    """Split vertices (v, x, y, z) at creases: the faces around a vertex (face, verts) stay together while they share an edge through it
    and their normals differ by no more than the angle; each further group gets a copy of the vertex. Returns new
    vertices (v, old, x, y, z) and faces; the group with the smallest face keeps the vertex."""
    n = face_normals(vertices, faces)
    ring = F.expr("transform(sequence(0, size(verts) - 1), i -> struct(verts[i] as v, verts[(i + size(verts) - 1) % size(verts)] as p, verts[(i + 1) % size(verts)] as q))")
    corner = stage(faces.select("face", F.explode(ring).alias("c")).select("face", "c.v", "c.p", "c.q").join(n, "face"))
    half = corner.select("face", "v", F.explode(F.array("p", "q")).alias("o"), "nx", "ny", "nz")
    a, b = half.alias("a"), half.alias("b")
    dot = sum(F.col(f"a.{c}") * F.col(f"b.{c}") for c in ("nx", "ny", "nz"))
    key = lambda s: F.struct(F.col(f"{s}.v").alias("v"), F.col(f"{s}.face").alias("face"))
    near = a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.o") == F.col("b.o")) & (F.col("a.face") < F.col("b.face"))).where(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))) <= angle)
    c = components(near.select(key("a").alias("a"), key("b").alias("b")))
    group = corner.select("face", "v", F.struct("v", "face").alias("node")).join(c, "node", "left").select("face", "v", F.coalesce("component.face", "face").alias("group"))
    keep = group.groupBy("v").agg(F.min("group").alias("g0"))
    top = vertices.agg(F.coalesce(F.max("v"), F.lit(-1))).first()[0] + 1
    extra = number_rows(group.join(keep, "v").where("group <> g0").select("v", "group").distinct(), "v", "group", start=top, name="new")
    corner_new = group.join(extra, ["v", "group"], "left").select("face", "v", F.coalesce("new", "v").alias("new"))
    new_vertices = vertices.select("v", F.col("v").alias("old"), *AXES).unionByName(extra.join(vertices, "v").select(F.col("new").alias("v"), F.col("v").alias("old"), *AXES))
    spread = faces.select("face", F.posexplode("verts").alias("k", "v")).join(corner_new, ["face", "v"])
    new_faces = spread.groupBy("face").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "new"))), lambda s: s["new"]).alias("verts"))
    return new_vertices, new_faces


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(face, nx, ny, nz, area, x, y, z): unit normal by Newell's sums, area and mean corner of each face."""
    from pyspark.sql import Window

    c = faces.select("face", F.posexplode("verts").alias("k", "v"), F.size("verts").alias("m")).join(vertices, "v")
    w = Window.partitionBy("face").orderBy("k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {a: F.coalesce(F.lead(a).over(w), F.first(a).over(whole)) for a in AXES}
    c = c.select("face", *AXES, *(e.alias(f"n{a}") for a, e in nxt.items()))
    cross = {"x": F.sum((F.col("y") - F.col("ny")) * (F.col("z") + F.col("nz"))), "y": F.sum((F.col("z") - F.col("nz")) * (F.col("x") + F.col("nx"))), "z": F.sum((F.col("x") - F.col("nx")) * (F.col("y") + F.col("ny")))}
    g = c.groupBy("face").agg(*(e.alias(f"s{a}") for a, e in cross.items()), *(F.avg(a).alias(a) for a in AXES))
    size = F.sqrt(sum(F.col(f"s{a}") ** 2 for a in AXES))
    return g.select("face", *(F.when(size > 0, F.col(f"s{a}") / size).otherwise(0.0).alias(f"n{a}") for a in AXES), (size / 2).alias("area"), *AXES)
