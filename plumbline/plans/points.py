"""Queries of the point-table operators. The test tables hold no clouds; `embeddings` stands in for one (its first three
dimensions are x, y, z, `label` a row-aligned label cloud), `part`, `orders`, `events` and `lineitem` for frames, boxes and faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import geometry, instances, matching, spatial, voxel
from plumbline.plans.labels import compile_filter, positional_join
from plumbline.plans.registry import Registry
from plumbline.session import table

R = Registry()

PTS = "p as (select vec_id as point_idx, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z, cast(label as bigint) as label from embeddings)"


def points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_idx"), *(e[i].cast("double").alias(a) for i, a in enumerate("xyz")), F.col("label").cast("long").alias("label"))


# ---- label filters

_FILTERS = {
    "filter_eq": ("label == 5", "label = 5"),
    "filter_in": ("label in [1, 2, 5]", "label in (1, 2, 5)"),
    "filter_not_equal": ("label != 1", "label <> 1"),
    "filter_range_and": ("label >= 3 && label <= 7", "label between 3 and 7"),
    "filter_or_paren": ("(label == 1 || label == 2) && label != 2", "label = 1"),
    "filter_precedence": ("label == 1 || label == 2 && label > 8", "label = 1 or (label = 2 and label > 8)"),
}


def _filter(text):
    return lambda spark, d: points(spark, d).where(compile_filter(text).column()).select("point_idx")


for _name, (_text, _where) in _FILTERS.items():
    R.query(_name, f"with {PTS} select point_idx from p where {_where}")(_filter(_text))


@R.query("filter_two_clouds", f"with {PTS} select point_idx from p where label in (1, 2) or floor(x * 10) = 1")
def filter_two_clouds(spark, d):
    p = points(spark, d)
    rooms = p.select("point_idx", F.floor(F.col("x") * 10).cast("long").alias("label"))
    f = compile_filter("planes in [1, 2] || rooms == 1")
    return positional_join({"planes": p.select("point_idx", "label"), "rooms": rooms}).where(f.column()).select("point_idx")


# ---- voxels and samples

_VOX = PTS + """, b as (select min(x) as mx, min(y) as my, min(z) as mz from p),
    v as (select p.*, cast(floor((x - mx) * (1.0::double / 0.1::double)) as bigint) as ix, cast(floor((y - my) * (1.0::double / 0.1::double)) as bigint) as iy, cast(floor((z - mz) * (1.0::double / 0.1::double)) as bigint) as iz from p, b)"""
_XYZ6 = ", ".join(f"round(avg({a}), 6) as {a}" for a in "xyz")


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@R.query("voxel_assign", f"""with {_VOX}, g as (select ix, iy, iz, row_number() over (order by min(point_idx)) - 1 as bucket from v group by ix, iy, iz)
    select point_idx, bucket from v join g using (ix, iy, iz)""")
def voxel_assign(spark, d):
    return voxel.voxel_assign(points(spark, d), 0.1)


@R.query("voxel_centroid", f"with {_VOX} select ix, iy, iz, count(*) as n, min(point_idx) as first, {_XYZ6} from v group by ix, iy, iz")
def voxel_centroid(spark, d):
    return voxel.voxel_centroid(points(spark, d), 0.1).select("ix", "iy", "iz", "n", "first", *_r6("x", "y", "z"))


@R.query("voxel_filtered", f"with {_VOX.replace('from embeddings)', 'from embeddings where label in (1, 2, 5))')} select ix, iy, iz, count(*) as n, min(point_idx) as first, {_XYZ6} from v group by ix, iy, iz")
def voxel_filtered(spark, d):
    """The flagship: a label filter, then voxels over what it keeps."""
    kept = points(spark, d).where(compile_filter("label in [1, 2] || label == 5").column())
    return voxel.voxel_centroid(kept, 0.1).select("ix", "iy", "iz", "n", "first", *_r6("x", "y", "z"))


@R.query("voxel_normals", f"""with {_VOX}, g as (select ix, iy, iz, row_number() over (order by min(point_idx)) - 1 as bucket, avg(x) as a, avg(y) as b, avg(z) as c, avg(abs(x)) as k from v group by ix, iy, iz)
    select bucket, round(a / sqrt(a*a + b*b + c*c), 6) as nx, round(b / sqrt(a*a + b*b + c*c), 6) as ny, round(c / sqrt(a*a + b*b + c*c), 6) as nz, round(k, 6) as curvature from g""")
def voxel_normals(spark, d):
    p = points(spark, d)
    normals = p.select("point_idx", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), F.abs("x").alias("curvature"))
    return voxel.voxel_normals(normals, voxel.voxel_assign(p, 0.1)).select("bucket", *_r6("nx", "ny", "nz", "curvature"))


@R.query("uniform_sample", f"""with {PTS}, c as (select *, cast(floor(x / 0.2::double) as bigint) as ix, cast(floor(y / 0.2::double) as bigint) as iy, cast(floor(z / 0.2::double) as bigint) as iz from p),
    r as (select *, row_number() over (partition by label, ix, iy, iz order by (x - (ix + 0.5) * 0.2::double)**2 + (y - (iy + 0.5) * 0.2::double)**2 + (z - (iz + 0.5) * 0.2::double)**2, point_idx) as k from c)
    select label, ix, iy, iz, point_idx from r where k = 1""")
def uniform_sample(spark, d):
    return voxel.uniform_sample(points(spark, d), 0.2).select("label", "ix", "iy", "iz", "point_idx")


@R.query("percentile_clip", f"""with {PTS}, n as (select count(*) as n from p),
    r as (select x, y, z, row_number() over (order by x) - 1 as rx, row_number() over (order by y) - 1 as ry, row_number() over (order by z) - 1 as rz from p),
    b as (select max(x) filter (rx = floor(0.01 * (n - 1))) as x0, max(x) filter (rx = floor(0.99 * (n - 1))) as x1, max(y) filter (ry = floor(0.01 * (n - 1))) as y0, max(y) filter (ry = floor(0.99 * (n - 1))) as y1,
        max(z) filter (rz = floor(0.01 * (n - 1))) as z0, max(z) filter (rz = floor(0.99 * (n - 1))) as z1 from r, n)
    select point_idx from p, b where x between x0 and x1 and y between y0 and y1 and z between z0 and z1""")
def percentile_clip(spark, d):
    p = points(spark, d)
    return voxel.percentile_clip(p, p).select("point_idx")


@R.query("stride_sample", "with n as (select ceil(count(*) / 1000.0) as step from orders), r as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as rn from orders) select o_orderkey from r, n where rn % step = 0")
def stride_sample(spark, d):
    return voxel.stride_sample(table(spark, d, "orders"), 1000, "o_orderdate", "o_orderkey").select("o_orderkey")


@R.query("chunk_frames", "select o_orderkey as node_id, cast(floor((row_number() over (order by o_orderkey) - 1) / 100.0) as bigint) as chunk from orders")
def chunk_frames(spark, d):
    return voxel.chunk_frames(table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id")), 100)


@R.query("camera_groups", """with k as (select p_partkey as node_id, p_size, cast(round(p_retailprice * 1000) as bigint) as f from part), g as (select p_size, f, row_number() over (order by min(node_id)) as camera_id from k group by all)
    select node_id, camera_id from k join g using (p_size, f)""")
def camera_groups(spark, d):
    p = table(spark, d, "part")
    price, size = F.col("p_retailprice"), F.col("p_size")
    return voxel.camera_groups(p.select(F.col("p_partkey").alias("node_id"), size.alias("width"), size.alias("height"), *(price.alias(c) for c in ("fx", "fy", "cx", "cy"))))


# ---- neighbourhoods

_PAIRS = PTS + ", j as (select a.point_idx as a, b.point_idx as b, a.label as la, b.label as lb, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) as d2, b.x as bx from p a, p b)"


@R.query("radius_neighbors", f"with {_PAIRS} select a, b from j where d2 <= 0.05::double * 0.05::double and a < b")
def radius_neighbors(spark, d):
    p = points(spark, d)
    return spatial.radius_join(p, p, 0.05).where("a < b").select("a", "b")


@R.query("knn_k", f"with {_PAIRS}, r as (select a, b, row_number() over (partition by a order by d2, b) as rank from j where a <> b) select a, b, cast(rank as int) as rank from r where rank <= 5")
def knn_k(spark, d):
    p = points(spark, d)
    return spatial.knn(p, p, 5).select("a", "b", "rank")


@R.query("knn_propagate", f"with {_PAIRS}, r as (select a as point_idx, lb as label, row_number() over (partition by a order by d2, b) as k from j where a % 10 <> 0 and b % 10 = 0) select point_idx, label from r where k = 1")
def knn_propagate(spark, d):
    p = points(spark, d)
    return spatial.propagate_labels(p.where("point_idx % 10 <> 0"), p.where("point_idx % 10 = 0"))


@R.query("anti_unsampled", f"with {PTS} select point_idx from p where not exists (select 1 from p q where q.point_idx = p.point_idx and q.point_idx % 10 = 0)")
def anti_unsampled(spark, d):
    p = points(spark, d)
    return p.join(p.where("point_idx % 10 = 0").select("point_idx"), "point_idx", "left_anti").select("point_idx")


@R.query("majority_label", f"""with {_PAIRS}, c as (select a, lb, count(*) as n from j where d2 <= 0.1::double * 0.1::double and lb <> 3 group by a, lb), r as (select a, lb, row_number() over (partition by a order by n desc, lb) as k from c)
    select point_idx, coalesce(lb, -1) as label from p left join r on a = point_idx and k = 1""")
def majority_label(spark, d):
    p = points(spark, d)
    return spatial.majority_vote(p, p.where("label <> 3"), 0.1)


_SOR = _PAIRS + ", r as (select a, d2, row_number() over (partition by a order by d2, b) as k from j where a <> b), m as (select a, avg(sqrt(d2)) as m from r where k <= 10 group by a)"


@R.query("sor_filter", f"with {_SOR} select a as point_idx from m where m <= (select avg(m) + stddev_samp(m) from m)")
def sor_filter(spark, d):
    return spatial.statistical_outliers(points(spark, d), 10, 1.0).where("keep").select("point_idx")


@R.query("ror_filter", f"with {_PAIRS} select a as point_idx, count(*) as n, count(*) >= 5 as keep from j where d2 <= 0.1::double * 0.1::double group by a")
def ror_filter(spark, d):
    return spatial.radius_outliers(points(spark, d), 0.1)


@R.query("idw_color", f"with {_PAIRS} select a as point_idx, round(sum(lb / (d2 + 1e-6)) / sum(1 / (d2 + 1e-6)), 6) as c from j where d2 <= 0.1::double * 0.1::double group by a")
def idw_color(spark, d):
    p = points(spark, d)
    return spatial.weighted_colour(p, p.withColumn("c", F.col("label").cast("double")), 0.1, ("c",)).select("point_idx", F.round("c", 6).alias("c"))


@R.query("pca_normals")
def pca_normals(spark, d):
    return spatial.pca_normals(points(spark, d), 0.15)


@R.query("instances_components", f"""with recursive {PTS}, e as (select a.point_idx as a, b.point_idx as b from p a, p b where a.label = b.label and a.label > 0 and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.15::double * 0.15::double),
    r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b), c as (select a, min(b) as first from r group by a), s as (select first, count(*) as n from c group by first having count(*) between 2 and 1000000),
    k as (select first, row_number() over (order by p.label, first) as instance from s join p on p.point_idx = first)
    select p.point_idx, p.label, coalesce(instance, 0) as instance from p left join c on c.a = p.point_idx left join k using (first)""")
def instances_components(spark, d):
    return instances.instances(points(spark, d), 0.15, 2)


@R.query("mesh_components", """with recursive f as (select o_orderkey as face, unnest([o_custkey // 3, o_custkey // 2 + 1000000]) as v from orders), e as (select distinct a.v as a, b.v as b from f a join f b using (face)),
    r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b), m as (select a as v, min(b) as part from r group by a) select face, min(part) as part from f join m using (v) group by face""")
def mesh_components(spark, d):
    o = table(spark, d, "orders")
    return instances.mesh_parts(o.select(F.col("o_orderkey").alias("face"), F.expr("array(o_custkey div 3, o_custkey div 2 + 1000000)").alias("verts")))


@R.query("frame_pairs", f"""with {PTS}, f as (select *, x / sqrt(x*x+y*y+z*z) as vx, y / sqrt(x*x+y*y+z*z) as vy, z / sqrt(x*x+y*y+z*z) as vz from p)
    select a.point_idx as a, b.point_idx as b from f a join f b on a.point_idx < b.point_idx and (b.point_idx - a.point_idx <= 5
        or ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.01::double and a.vx*b.vx + a.vy*b.vy + a.vz*b.vz >= 0.5))""")
def frame_pairs(spark, d):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return matching.frame_pairs(points(spark, d).select("point_idx", "x", "y", "z", *((F.col(a) / r).alias(f"v{a}") for a in "xyz")), 5, 0.1, 0.5)


# ---- matches

@R.query("nearest_timestamp", """with q as (select event_id as query_id, ts from events where event_type = 'signup'), f as (select event_id as node_id, ts from events where event_type = 'view'),
    r as (select query_id, node_id, abs(epoch_us(f.ts) - epoch_us(q.ts)) as dt_us, row_number() over (partition by query_id order by abs(epoch_us(f.ts) - epoch_us(q.ts)), node_id) as k from q, f)
    select query_id, node_id, dt_us from r where k = 1""")
def nearest_timestamp(spark, d):
    e = table(spark, d, "events")
    return matching.nearest_in_time(e.where("event_type = 'signup'").select(F.col("event_id").alias("query_id"), "ts"), e.where("event_type = 'view'").select(F.col("event_id").alias("node_id"), "ts"))


@R.query("argmin_cost_match", f"""with {PTS}, i as (select point_idx as instance_id, x, y, z, x / sqrt(x*x+y*y+z*z) as nx, y / sqrt(x*x+y*y+z*z) as ny, z / sqrt(x*x+y*y+z*z) as nz from p),
    m as (select label as wall_id, avg(x) as x, avg(y) as y, avg(z) as z from p group by label), w as (select wall_id, x / sqrt(x*x+y*y+z*z) as a, y / sqrt(x*x+y*y+z*z) as b, z / sqrt(x*x+y*y+z*z) as c, 0.1::double as d from m),
    r as (select instance_id, wall_id, acos(least(1.0, abs(nx*a + ny*b + nz*c))) as ang, abs(x*a + y*b + z*c + d) as far from i, w where acos(least(1.0, abs(nx*a + ny*b + nz*c))) <= radians(50.0)),
    k as (select instance_id, wall_id, ang + 0.5 * far as cost, row_number() over (partition by instance_id order by ang + 0.5 * far, wall_id) as k from r)
    select i.instance_id, wall_id, round(cost, 6) as cost from i left join k on k.instance_id = i.instance_id and k.k = 1""")
def argmin_cost_match(spark, d):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    i = points(spark, d).select(F.col("point_idx").alias("instance_id"), "x", "y", "z", *((F.col(a) / r).alias(f"n{a}") for a in "xyz"), F.lit(0.5).alias("flatness"))
    w = points(spark, d).groupBy(F.col("label").alias("wall_id")).agg(*(F.avg(a).alias(a) for a in "xyz")).select("wall_id", *((F.col(a) / r).alias(n) for a, n in zip("xyz", "abc")), F.lit(0.1).alias("d"))
    return matching.cheapest_wall(i, w).select("instance_id", "wall_id", F.round("cost", 6).alias("cost"))


_BOX = "b as (select p_partkey as box_id, p_partkey // 20 as image, p_size % 2 as class, cast(p_partkey % 13 as double) as x1, cast(p_partkey % 11 as double) as y1, cast(p_partkey % 13 + 4 + p_size % 3 as double) as x2, cast(p_partkey % 11 + 5 as double) as y2, p_retailprice as score from part)"


def boxes(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey as box_id", "p_partkey div 20 as image", "p_size % 2 as class", "cast(p_partkey % 13 as double) as x1", "cast(p_partkey % 11 as double) as y1",
                                              "cast(p_partkey % 13 + 4 + p_size % 3 as double) as x2", "cast(p_partkey % 11 + 5 as double) as y2", "p_retailprice as score")


@R.query("iou_pairs", f"""with {_BOX}, j as (select a.image, a.class, a.box_id as a, b.box_id as b, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i,
    (a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) as u from b a join b on a.image = b.image and a.class = b.class and (a.score > b.score or (a.score = b.score and a.box_id < b.box_id)))
    select image, class, a, b, round(i / (u - i), 6) as iou from j where i > 0""")
def iou_pairs(spark, d):
    return matching.iou_pairs(boxes(spark, d)).withColumn("iou", F.round("iou", 6))


# ---- geometry

@R.query("rigid_transform", f"with {PTS} select point_idx, round(-y + 1, 6) as x, round(x + 2, 6) as y, round(z - 3, 6) as z from p")
def rigid_transform(spark, d):
    return geometry.rigid(points(spark, d), [0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, -3, 0, 0, 0, 1]).select("point_idx", *_r6("x", "y", "z"))


@R.query("back_project", "select l_orderkey, l_linenumber, round(((l_partkey % 64) - 32.0) * l_quantity / 50.0, 6) as x, round(((l_suppkey % 48) - 24.0) * l_quantity / 40.0, 6) as y, l_quantity as z from lineitem where l_quantity between 5 and 40 and l_partkey % 64 % 4 = 0 and l_suppkey % 48 % 4 = 0")
def back_project(spark, d):
    px = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 64 as u", "l_suppkey % 48 as v", "l_quantity as z", "3 as conf", "50.0D as fx", "40.0D as fy", "32.0D as cx", "24.0D as cy")
    return geometry.back_project(px, 5, 40, 2, 4).select("l_orderkey", "l_linenumber", *_r6("x", "y"), "z")


@R.query("plane_distance", f"with {PTS} select point_idx, round((x + 2*y + 2*z + 0.5) / 9, 6) as dist from p")
def plane_distance(spark, d):
    return points(spark, d).select("point_idx", F.round(geometry.plane_distance(*(F.lit(v) for v in (1.0, 2.0, 2.0, 0.5))), 6).alias("dist"))


@R.query("plane_classify", f"with {PTS}, n as (select point_idx, abs(z / sqrt(x*x+y*y+z*z)) as up from p) select point_idx, case when up < 0.1 then 'vertical' when abs(up - 1) < 0.1 then 'horizontal' else 'tilted' end as kind from n")
def plane_classify(spark, d):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return points(spark, d).select("point_idx", geometry.plane_class(0.1, F.col("z") / r).alias("kind"))


_CORNERS = "c as (select id as polygon, generate_subscripts(boundary, 1) as k, unnest(boundary) as q from (select id, any_value(boundary) as boundary from building_components where id is not null group by id))"


@R.query("polygon_area", f"""with {_CORNERS}, e as (select polygon, k, q.x as x, q.y as y, q.z as z, coalesce(lead(q) over w, first(q) over w) as r from c window w as (partition by polygon order by k rows between unbounded preceding and unbounded following)),
    s as (select polygon, count(*) as n, sum(y*r.z - z*r.y) as a, sum(z*r.x - x*r.z) as b, sum(x*r.y - y*r.x) as c from e group by polygon)
    select polygon, n, case when n >= 3 then round(sqrt(a*a + b*b + c*c) / 2, 4) else 0 end as area from s""")
def polygon_area(spark, d):
    c = table(spark, d, "building_components").where("id is not null").select(F.col("id").alias("polygon"), "boundary").dropDuplicates(["polygon"]).select("polygon", F.posexplode("boundary").alias("k", "q"))
    return geometry.polygon_measures(c.select("polygon", "k", "q.x", "q.y", "q.z")).select("polygon", "n", F.round("area", 4).alias("area"))


@R.query("bbox", f"with {PTS} select label, min(x) as lo_x, max(x) as hi_x, min(y) as lo_y, max(y) as hi_y, min(z) as lo_z, max(z) as hi_z, count(*) as n from p group by label")
def bbox(spark, d):
    return geometry.bounds(points(spark, d), "label")


@R.query("weighted_centroid", f"with {PTS} select label as region, round(sum(x * abs(z)) / sum(abs(z)), 6) as x, round(sum(y * abs(z)) / sum(abs(z)), 6) as y, round(sum(abs(z)), 6) as area from p group by label")
def weighted_centroid(spark, d):
    f = points(spark, d).select(F.col("label").alias("region"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), "x", "y", "z", F.abs("z").alias("area"))
    return geometry.region_means(f).select("region", *_r6("x", "y", "area"))


@R.query("plane_set", f"""with {PTS}, g as (select label, avg(x) as x, avg(y) as y, avg(z) as z, count(*) as n, dense_rank() over (order by label) - 1 as rank from p where label > 0 group by label)
    select label as plane_id, n, round(-(x * cos(rank) + y * sin(rank)), 6) as d from g""")
def plane_set(spark, d):
    normals = spark.range(100).select(F.col("id").cast("int").alias("rank"), F.cos("id").alias("a"), F.sin("id").alias("b"), F.lit(0.0).alias("c"))
    return geometry.planes_of(points(spark, d), normals).select("plane_id", "n", F.round("d", 6).alias("d"))


@R.query("inlier_ratio", f"with {PTS} select label, round(count(*) filter (abs(x + y) < 0.1) / count(*), 6) as ratio from p group by label")
def inlier_ratio(spark, d):
    return points(spark, d).groupBy("label").agg(F.round(F.count_if(F.abs(F.col("x") + F.col("y")) < 0.1) / F.count("*"), 6).alias("ratio"))


@R.query("rms", f"with {PTS} select label, round(sqrt(avg(x * x)), 6) as rms from p group by label")
def rms(spark, d):
    return points(spark, d).groupBy("label").agg(F.round(F.coalesce(F.sqrt(F.avg(F.col("x") * F.col("x"))), F.lit(0.0)), 6).alias("rms"))


@R.query("depth_stats", "select l_suppkey, round(coalesce(avg(l_quantity) filter (l_returnflag = 'R'), 0), 6) as mean, coalesce(min(l_quantity) filter (l_returnflag = 'R'), 0) as lo, coalesce(max(l_quantity) filter (l_returnflag = 'R'), 0) as hi from lineitem group by l_suppkey")
def depth_stats(spark, d):
    q = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.coalesce(F.avg(q), F.lit(0.0)), 6).alias("mean"), *(F.coalesce(f(q), F.lit(0.0)).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))))


@R.query("class_breakdown", f"with {PTS} select label, count(*) as n, min(point_idx) as first from p group by label")
def class_breakdown(spark, d):
    return points(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min("point_idx").alias("first"))


@R.query("distinct_labels", f"with {PTS} select distinct label from p where label <> 0")
def distinct_labels(spark, d):
    return points(spark, d).where("label <> 0").select("label").distinct()


@R.query("semi_labels", f"with {PTS} select point_idx from p where exists (select 1 from p q where q.label = p.label and abs(q.x) < 0.002)")
def semi_labels(spark, d):
    p = points(spark, d)
    return p.join(p.where("abs(x) < 0.002").select("label"), "label", "left_semi").select("point_idx")
