"""Queries of stored meshes and passports, coded values, component payloads, seed points and walls between cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import codes
from plumbline.operators import cells, images, store, vision
from plumbline.plans.points import PTS, points
from plumbline.plans.registry import Registry
from plumbline.session import table

R = Registry()


@R.query("component_payload", """with c as (select distinct id, lower(trim(type)) as kind, confidence from building_components where id is not null)
    select id, kind, case when kind in ('window', 'door') then 's' || (id % 3) end as style, case when kind = 'window' then cast(id % 4 as int) else -1 end as pane_count, case when kind = 'window' then confidence > 0.5 end as operable, case when kind = 'door' then 'left' end as swing
    from c where kind in ('window', 'door', 'wall')""")
def component_payload(spark, d):
    c = table(spark, d, "building_components").where("id is not null").select("id", F.lower(F.trim("type")).alias("kind"), "confidence").distinct()
    style = F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))
    c = c.withColumn("p", codes.read_payload(codes.component_payload("kind", style=style, pane_count=F.col("id") % 4, operable=F.col("confidence") > 0.5, swing=F.lit("left"))))
    return c.where("p is not null").select("id", F.col("p.component_type").alias("kind"), "p.style", F.coalesce("p.pane_count", F.lit(-1)).alias("pane_count"), "p.operable", "p.swing")


_LIST = "[" + ", ".join(f"'{v}'" for v in codes.CODES["material"]) + "]"


@R.query("enum_codes", f"""with v as (select id, unnest(case when json_valid(decode(value)) and starts_with(decode(value), '[') then from_json(decode(value), '["VARCHAR"]') else [decode(value)] end) as x from (select distinct id, value from passport_property_values where value is not null))
    select id, x as code, cast(list_position({_LIST}, x) - 1 as int) as n, count(*) as times from v where x in (select unnest({_LIST})) group by all""")
def enum_codes(spark, d):
    v = table(spark, d, "passport_property_values").where("value is not null").select("id", F.decode("value", "UTF-8").alias("t")).distinct()
    v = v.select("id", F.explode(F.coalesce(F.from_json("t", "array<string>"), F.array("t"))).alias("x"))
    return v.select("id", codes.code("x", "material").alias("code"), codes.code_number("x", "material").alias("n")).where("code is not null").groupBy("id", "code", "n").agg(F.count("*").alias("times"))


@R.query("passport_log", "select c_name as document_guid, o_orderpriority as entry_type, o_orderstatus as target_guid, o_orderdate as edited_at, o_totalprice as new_value from orders join customer on c_custkey = o_custkey")
def passport_log(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("document_guid"))
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("passport_id"), F.col("o_orderpriority").alias("entry_type"), F.col("o_orderstatus").alias("target_guid"), F.lit("x").alias("edited_by"),
                                           F.col("o_orderdate").alias("edited_at"), F.lit(None).cast("double").alias("old_value"), F.col("o_totalprice").alias("new_value"))
    return store.passport_entries(p, log).select("document_guid", "entry_type", "target_guid", "edited_at", "new_value")


def _passports(v):
    return v.select(F.col("passport_id").alias("id"), F.concat(F.lit("doc-"), "passport_id").alias("document_guid")).where("id is not null").distinct()


@R.query("passport_values", """with d as (select id, leksikon_guid as g, field_name from property_definitions), f as (select g, arg_min(field_name, id) as field_name from d where g is not null group by g), i as (select id, min(field_name) as field_name from d group by id),
    v as (select v.*, coalesce(i.field_name, case when property_id is null then f.field_name end) as field_name from passport_property_values v left join i on i.id = property_id left join f on f.g = leksikon_guid)
    select 'doc-' || passport_id as document_guid, sort_order, field_name, decode(value) as value, count(*) as n from v where field_name is not null and passport_id is not null group by all""")
def passport_values(spark, d):
    v = table(spark, d, "passport_property_values")
    return store.passport_values(_passports(v), v, table(spark, d, "property_definitions")).groupBy("document_guid", "sort_order", "field_name", "value").agg(F.count("*").alias("n"))


@R.query("replace_passport", """with v as (select passport_id, value from passport_property_values where passport_id not like '%7' union all select distinct passport_id, encode('new') from passport_property_values where passport_id like '%7')
    select passport_id, count(*) as n, count(*) filter (decode(value) = 'new') as n_new from v group by passport_id""")
def replace_passport(spark, d):
    v = table(spark, d, "passport_property_values")
    p = _passports(v)
    new = p.where("id like '%7'")
    rows = new.select(F.concat("id", F.lit("-n")).alias("id"), F.col("id").alias("passport_id"), F.lit("custom:x").alias("property_id"), F.lit("x").alias("field_name"), F.lit(None).cast("string").alias("leksikon_guid"), F.lit(0).alias("sort_order"), F.lit(b"new").alias("value"))
    out = store.replace_passport({"material_passports": p, "passport_property_values": v, "property_definitions": table(spark, d, "property_definitions")}, new, rows)
    return out["passport_property_values"].groupBy("passport_id").agg(F.count("*").alias("n"), F.count_if(F.decode("value", "UTF-8") == "new").alias("n_new"))


@R.query("mesh_store", """with t as (select distinct l_partkey as k, l_suppkey as tex from lineitem), n as (select p_partkey from part where p_size > 25), x as (select k, tex from t where k not in (select p_partkey from n) union all select p_partkey, -1 from n)
    select cast(p_partkey as varchar) as name, count(k) as n_textures, max(case when p_size > 25 then 'new' else p_brand end) as format from part left join x on k = p_partkey group by p_partkey""")
def mesh_store(spark, d):
    p = table(spark, d, "part")
    mesh = p.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("format"), F.col("p_size").alias("vertex_count"), F.col("p_size").alias("face_count"))
    tex = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("mesh_name"), F.col("l_suppkey").cast("string").alias("tex_name")).distinct()
    new = mesh.where("vertex_count > 25").withColumn("format", F.lit("new"))
    out = store.save_mesh({"meshes": mesh, "mesh_texture_data": tex}, new, new.select(F.col("name").alias("mesh_name"), F.lit("-1").alias("tex_name")))
    n = out["mesh_texture_data"].groupBy(F.col("mesh_name").alias("name")).agg(F.count("*").alias("n_textures"))
    return out["meshes"].join(n, "name", "left").select("name", F.coalesce("n_textures", F.lit(0)).alias("n_textures"), "format")


@R.query("seed_views", f"""with {PTS}, f as (select distinct label as node_id, label * 0.1::double as off from p),
    r as (select point_idx, node_id, (x + off) * 20 / (z + 0.1::double) + 16 as u, y * 20 / (z + 0.1::double) + 16 as v from p, f where z + 0.1::double > 0.01)
    select point_idx, list_sort(list(node_id)) as views from r where u >= 0 and u < 32 and v >= 0 and v < 32 group by point_idx""")
def seed_views(spark, d):
    p = points(spark, d)
    frames = p.select(F.col("label").alias("node_id")).distinct().select(
        "node_id", F.array(*(F.lit(x).cast("double") for x in (1, 0, 0)), F.col("node_id") * F.lit(0.1), *(F.lit(x).cast("double") for x in (0, 1, 0, 0, 0, 0, 1, 0.1))).alias("view"), *(F.lit(v).alias(c) for c, v in (("fx", 20.0), ("fy", 20.0), ("cx", 16.0), ("cy", 16.0), ("width", 32), ("height", 32))))
    return images.seed_views(p, frames)


@R.query("wall_steps", """with m as (select n_nationkey as cell, list_sort(list_distinct([n_regionkey, n_nationkey % 4, n_nationkey % 7])) as walls from nation), f as (select p_partkey as face, p_partkey % 29 - 1 as a, p_size % 25 as b from part),
    j as (select face, coalesce(x.walls, []) as wa, coalesce(y.walls, []) as wb from f left join m x on x.cell = a left join m y on y.cell = b)
    select face, list_sort(list_filter(wa, lambda w: not list_contains(wb, w))) as "left", list_sort(list_filter(wb, lambda w: not list_contains(wa, w))) as entered, list_sort(list_distinct(list_concat(wa, wb))) as either from j""")
def wall_steps(spark, d):
    m = table(spark, d, "nation").selectExpr("n_nationkey as cell", "array_distinct(array(n_regionkey, n_nationkey % 4, n_nationkey % 7)) as walls")
    return cells.wall_steps(table(spark, d, "part").selectExpr("p_partkey as face", "p_partkey % 29 - 1 as a", "p_size % 25 as b"), m)


@R.query("shuffled", "select p_partkey from part")
def shuffled(spark, d):
    return vision.shuffled(table(spark, d, "part").select("p_partkey"), 7)
