"""Queries of the operators on planes, rooms, meshes, detections and passports. Where SQL can't say an operator (greedy or iterative ones), the query is checked by its rows and by unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cells, images, instances, passports, planes, spatial, texture, vision, voxel, windows
from plumbline.plans.points import _BOX, PTS, boxes, points
from plumbline.plans.registry import Registry
from plumbline.session import stage, table
from plumbline.sources import cloudfiles, exports

R = Registry()


def _with_normals(p):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return p.select("*", *((F.col(a) / r).alias(f"n{a}") for a in "xyz"), F.abs("x").alias("curvature"))


@R.query("nms_greedy")
def nms_greedy(spark, d):
    return vision.suppress(boxes(spark, d), 0.3, 0.0).select("image", "class", "box_id")


@R.query("box_centres", f"with {_BOX} select box_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as w, y2 - y1 as h from b")
def box_centres(spark, d):
    return vision.centres(boxes(spark, d)).select("box_id", "cx", "cy", "w", "h")


@R.query("best_class", "select vec_id, list_position(s, list_max(s)) - 1 as class, round(list_max(s)::double, 6) as score from (select vec_id, embedding[1:10] as s from embeddings)")
def best_class(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 10).alias("scores"))
    return vision.best_class(e).select("vec_id", "class", F.round(F.col("score").cast("double"), 6).alias("score"))


@R.query("presence_filter", f"with {PTS} select point_idx, round(1 / (1 + exp(-x * 4)) * (abs(y) + 0.5), 6) as score from p where 1 / (1 + exp(-x * 4)) * (abs(y) + 0.5) >= 0.35")
def presence_filter(spark, d):
    b = points(spark, d).select("point_idx", (F.col("x") * 4).alias("logit"), (F.abs("y") + 0.5).alias("presence"), *(F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")), F.lit(10).alias("width"), F.lit(10).alias("height"))
    return vision.presence_filter(b, 0.35).select("point_idx", F.round("score", 6).alias("score"))


@R.query("label_metadata", "select l_orderkey as node_id, coalesce(list_sort(list_distinct(list(l_linenumber - 2) filter (l_linenumber >= 2))), []) as classes from lineitem group by l_orderkey")
def label_metadata(spark, d):
    return images.label_metadata(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), (F.col("l_linenumber") - 2).alias("label")))


@R.query("region_growing")
def region_growing(spark, d):
    return planes.grow_regions(_with_normals(points(spark, d)).withColumn("cloud", F.col("label")), 40.0, 0.1, 5, 0.2)


@R.query("coplanar_components")
def coplanar_components(spark, d):
    return planes.coplanar_components(_with_normals(points(spark, d)), 40.0, 0.1, 5, 0.1)


@R.query("plane_fit")
def plane_fit(spark, d):
    return planes.refit_planes(points(spark, d).withColumnRenamed("label", "plane"))


_FACES = "f as (select p_partkey as face, [p_partkey % 97, p_partkey % 89 + 97, p_partkey % 83 + 186] as verts from part), v as (select vec_id as v, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"


def _mesh(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("face"), F.expr("array(p_partkey % 97, p_partkey % 89 + 97, p_partkey % 83 + 186)").alias("verts"))
    return points(spark, d).select(F.col("point_idx").alias("v"), "x", "y", "z"), f


@R.query("face_areas", f"""with {_FACES}, t as (select face, a.x - c.x as ax, a.y - c.y as ay, a.z - c.z as az, b.x - c.x as bx, b.y - c.y as by_, b.z - c.z as bz from f join v a on a.v = verts[1] join v b on b.v = verts[2] join v c on c.v = verts[3])
    select face, round(sqrt((ay*bz - az*by_)**2 + (az*bx - ax*bz)**2 + (ax*by_ - ay*bx)**2) / 2, 6) as area from t""")
def face_areas(spark, d):
    return instances.face_normals(*_mesh(spark, d)).select("face", F.round("area", 6).alias("area"))


@R.query("unweld")
def unweld(spark, d):
    return instances.unweld(*_mesh(spark, d))[0].select("v", "old")


@R.query("planar_regions")
def planar_regions(spark, d):
    return windows.planar_regions(*_mesh(spark, d), 20.0, 0.05)


@R.query("instance_planes")
def instance_planes(spark, d):
    return windows.instance_planes(points(spark, d).withColumnRenamed("label", "instance"))


@R.query("create_windows")
def create_windows(spark, d):
    p = points(spark, d)
    walls = _with_normals(p).where("abs(nz) < 0.3").select(F.col("point_idx").alias("wall_id"), F.col("nx").alias("a"), F.col("ny").alias("b"), F.col("nz").alias("c"), F.lit(0.1).alias("d"))
    return windows.create_windows(p.withColumnRenamed("label", "instance"), walls, 0.1)[0].select("instance_id", "wall_id", "name", "width", "height")


@R.query("face_coverage", f"""with {PTS}, c as (select label as face, floor(x / 0.2::double) + i as i, floor(y / 0.2::double) + j as j, x, y from p, (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j)),
    h as (select distinct face, i, j from c where (x - (i + 0.5) * 0.2::double)**2 + (y - (j + 0.5) * 0.2::double)**2 <= 0.01::double and i between 0 and 2 and j between 0 and 2)
    select l.face, round(count(h.face) / 9, 6) as coverage from (select distinct label as face from p) l left join h on h.face = l.face group by l.face""")
def face_coverage(spark, d):
    p = points(spark, d)
    faces = p.select(F.col("label").alias("face")).distinct().select("face", F.lit(3).alias("nu"), F.lit(3).alias("nv"))
    return cells.face_coverage(p.select(F.col("label").alias("face"), F.col("x").alias("u"), F.col("y").alias("v")), faces, 0.2).select("face", F.round("coverage", 6).alias("coverage"))


@R.query("texture_groups", f"""with recursive {PTS}, n as (select label as mesh, point_idx as face, x / sqrt(x*x+y*y+z*z) as nx, y / sqrt(x*x+y*y+z*z) as ny, z / sqrt(x*x+y*y+z*z) as nz, row_number() over (partition by label order by point_idx) as k from p),
    r as (select mesh, face, k, nx, ny, nz, 0 as g from n where k = 1
        union all select n.mesh, n.face, n.k, case when s then r.nx else n.nx end, case when s then r.ny else n.ny end, case when s then r.nz else n.nz end, case when s then g else g + 1 end
        from r join n on n.mesh = r.mesh and n.k = r.k + 1, lateral (select r.nx*n.nx + r.ny*n.ny + r.nz*n.nz >= 0.5 as s))
    select mesh, face, g as "group" from r""")
def texture_groups(spark, d):
    n = _with_normals(points(spark, d)).select(F.col("label").alias("mesh"), F.col("point_idx").alias("face"), "nx", "ny", "nz")
    return texture.face_groups(n, 0.5)


@R.query("typed_values", r"""with d as (select id, min(lower(trim(type))) as kind, min(field_name) as field_name from property_definitions group by id),
    v as (select id, property_id, nullif(regexp_replace(decode(value), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') as x from passport_property_values)
    select v.id, field_name, case when kind = 'integer' and regexp_full_match(x, '[+-]?[0-9]+') then cast(x as bigint) end as as_integer,
        case when kind = 'boolean' and lower(x) in ('true', '1') then true when kind = 'boolean' and lower(x) in ('false', '0') then false end as as_boolean, count(*) as n from v join d on d.id = property_id group by all""")
def typed_values(spark, d):
    p = table(spark, d, "property_definitions").groupBy(F.col("id").alias("property_id")).agg(F.min(F.lower(F.trim("type"))).alias("kind"), F.min("field_name").alias("field_name"))
    v = table(spark, d, "passport_property_values").select("id", F.col("passport_id"), "property_id", F.decode("value", "UTF-8").alias("text")).join(p, "property_id")
    return passports.typed_values(v).groupBy("id", "field_name", "as_integer", "as_boolean").agg(F.count("*").alias("n"))


@R.query("passport_import")
def passport_import(spark, d):
    return passports.from_json(table(spark, d, "passport_records"))[0].distinct()


@R.query("passport_export")
def passport_export(spark, d):
    p = table(spark, d, "property_definitions")
    v = table(spark, d, "passport_property_values").select("passport_id", "property_id", F.decode("value", "UTF-8").alias("text"), "recorded_at").join(F.broadcast(p.select(F.col("id").alias("property_id"), "field_name")) if p.limit(20_001).count() <= 20_000 else p.select(F.col("id").alias("property_id"), "field_name"), "property_id")
    return passports.to_json(v.groupBy("passport_id", "field_name").agg(F.max_by("text", F.struct("recorded_at", "text")).alias("text")), p)


@R.query("cloud_points", "with c as (select distinct id, point_type from point_clouds), b as (select cloud_id, point_type, octet_length(data) as n from point_cloud_data join c on c.id = cloud_id) select cloud_id, cast(sum(case point_type when 'PointXYZRGB' then n // 16 when 'PointXYZ' then n // 12 when 'Label' then n // 4 else 0 end) as bigint) as n from b group by cloud_id having n > 0")
def cloud_points(spark, d):
    c = table(spark, d, "point_clouds").select(F.col("id").alias("cloud_id"), "point_type").distinct()
    return cloudfiles.decode_blobs(table(spark, d, "point_cloud_data").join(c, "cloud_id")).groupBy("cloud_id").agg(F.count("*").alias("n"))


@R.query("camera_scene_points")
def camera_scene_points(spark, d):
    p = points(spark, d).select("point_idx", "x", "y", "z", *(F.lit(v).alias(c) for c, v in (("r", 1), ("g", 2), ("b", 3))))
    frames = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.array(*(F.lit(float(v)) for v in (1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1))).alias("pose"), *(F.col("p_retailprice").alias(c) for c in ("fx", "fy", "cx", "cy")), *(F.col("p_size").alias(c) for c in ("width", "height")))
    scene = exports.camera_scene(frames, p)
    return scene["cameras"].select(F.lit("cameras").alias("part"), "line").unionByName(scene["points3D"].select(F.lit("points3D").alias("part"), "line"))


@R.query("dense_wrapper", f"""with recursive {PTS}, q as (select * from p where abs(x) <= 0.3 and abs(y) <= 0.3 and abs(z) <= 0.3), j as (select a.point_idx as a, b.point_idx as b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) as d2 from q a, q b where a.point_idx <> b.point_idx),
    r as (select a, d2, row_number() over (partition by a order by d2, b) as k from j), m as (select a, avg(sqrt(d2)) as m from r where k <= 5 group by a) select a as point_idx from m where m <= (select avg(m) + 2 * stddev_samp(m) from m)""".replace("with recursive", "with"))
def dense_wrapper(spark, d):
    """Clip a dense cloud to a box, then drop statistical outliers."""
    p = stage(points(spark, d).where("abs(x) <= 0.3 and abs(y) <= 0.3 and abs(z) <= 0.3"))
    return spatial.statistical_outliers(p, 5, 2.0).where("keep").select("point_idx")


@R.query("downsample_labels", f"""with {PTS}, b as (select min(x) as mx, min(y) as my, min(z) as mz from p), v as (select label, floor((x - mx) * (1.0::double / 0.3::double)) as i, floor((y - my) * (1.0::double / 0.3::double)) as j, floor((z - mz) * (1.0::double / 0.3::double)) as k from p, b),
    c as (select i, j, k, label, count(*) as n from v group by all), r as (select *, row_number() over (partition by i, j, k order by n desc, label) as o from c) select cast(i as bigint) as ix, cast(j as bigint) as iy, cast(k as bigint) as iz, label from r where o = 1""")
def downsample_labels(spark, d):
    """The commonest label of each voxel."""
    c = voxel.voxel_cells(points(spark, d), 0.3).groupBy("ix", "iy", "iz", "label").agg(F.count("*").alias("n"))
    return c.groupBy("ix", "iy", "iz").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("ix", "iy", "iz", "m.label")
