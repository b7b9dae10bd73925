"""Queries over the project database: paths, passports, labels, components, the log, and changes to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.functions.ranking import number_rows
from plumbline.operators import geometry, store
from plumbline.plans import paths
from plumbline.plans.points import PTS, points
from plumbline.plans.registry import Registry
from plumbline.session import table

R = Registry()


@R.query("wildcard_items", "select distinct name as item, id from point_clouds where regexp_full_match(name, 'instances_.*')")
def wildcard_items(spark, d):
    return paths.resolve({"clouds": table(spark, d, "point_clouds")}, "clouds.instances_*").select("item", "id").distinct()


@R.query("index_item", "select id as item, name as value from (select *, row_number() over (order by id, name, recorded_at) as rn from projects) where rn = 6")
def index_item(spark, d):
    p = number_rows(table(spark, d, "projects"), "id", "name", "recorded_at").where("rn = 6")
    return p.select(F.col("id").alias("item"), F.col("name").alias("value"))


@R.query("path_property", "select distinct name as item, cast(point_count as varchar) as value from point_clouds where regexp_full_match(name, 'rooms.*')")
def path_property(spark, d):
    return paths.resolve({"clouds": table(spark, d, "point_clouds")}, "clouds/rooms*/point_count").distinct()


@R.query("property_count", "select passport_id, count(*) as n, max(sort_order) + 1 as next_sort_order from passport_property_values group by passport_id")
def property_count(spark, d):
    v = table(spark, d, "passport_property_values")
    return v.groupBy("passport_id").agg(F.count("*").alias("n")).join(store.first_property_number(v), "passport_id")


@R.query("eav_properties", """select v.passport_id, v.sort_order, d.field_name, d.category, decode(v.value) as value, count(*) as n
    from passport_property_values v join property_definitions d on d.id = v.property_id group by all""")
def eav_properties(spark, d):
    v, p = table(spark, d, "passport_property_values"), table(spark, d, "property_definitions").select(F.col("id").alias("property_id"), "field_name", "category")
    j = v.join(F.broadcast(p) if p.limit(20_001).count() <= 20_000 else p, "property_id")
    return j.groupBy("passport_id", "sort_order", "field_name", "category", F.decode("value", "UTF-8").alias("value")).agg(F.count("*").alias("n"))


@R.query("label_names", """with l as (select distinct cloud_id, label_id, name from label_definitions where cloud_id is not null), c as (select distinct id, project_id, name from point_clouds), k as (select distinct c.project_id, l.label_id from c join l on l.cloud_id = c.id)
    select c.id, c.name as cloud, k.label_id, coalesce(l.name, 'class_' || k.label_id) as label from c join k using (project_id) left join l on l.cloud_id = c.id and l.label_id = k.label_id""")
def label_names(spark, d):
    # every label that some cloud of the project has, for each of its clouds
    c = table(spark, d, "point_clouds").select("id", "project_id", F.col("name").alias("cloud")).distinct()
    n = table(spark, d, "label_definitions").where("cloud_id is not null").select(F.col("cloud_id").alias("id"), "label_id", "name").distinct()
    c = c.join(c.join(n, "id").select("project_id", "label_id").distinct(), "project_id")
    return c.join(n, ["id", "label_id"], "left").select("id", "cloud", "label_id", F.coalesce("name", F.concat(F.lit("class_"), "label_id")).alias("label"))


@R.query("count_by_type", "select lower(trim(type)) as type, count(distinct id) as n, round(avg(confidence) filter (confidence >= 0), 6) as confidence from building_components group by 1")
def count_by_type(spark, d):
    b = table(spark, d, "building_components")
    return b.groupBy(F.lower(F.trim("type")).alias("type")).agg(F.count_distinct("id").alias("n"), F.round(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), 6).alias("confidence"))


_SUMMARY = [("projects", "id"), ("point_clouds", "id"), ("building_components", "id"), ("passport_property_values", "passport_id")]


@R.query("summary", " union all ".join(f"select '{t}' as section, count(*) as n_rows, count(distinct {k}) as n_keys from {t}" for t, k in _SUMMARY))
def summary(spark, d):
    out = None
    for t, k in _SUMMARY:
        one = table(spark, d, t).agg(F.lit(t).alias("section"), F.count("*").alias("n_rows"), F.count_distinct(k).alias("n_keys"))
        out = one if out is None else out.unionByName(one)
    return out


@R.query("log_latest", "select event_id as id, event_type as stage from events order by event_id desc limit 20")
def log_latest(spark, d):
    return store.latest_log(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stage")), 20)


@R.query("json_params", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_params(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.query("json_class_map", "select distinct c.id, unnest(json_keys(c.metadata)) as key, json_extract_string(c.metadata, '$.' || unnest(json_keys(c.metadata))) as value from building_components c where json_valid(metadata)")
def json_class_map(spark, d):
    return table(spark, d, "building_components").select("id", F.explode(F.from_json("metadata", "map<string,string>")).alias("key", "value")).distinct()


@R.query("duration_text", """with t as (select event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as te from events), s as (select *, cast(floor(epoch_us(te) / 1e6) - floor(epoch_us(ts) / 1e6) as bigint) as s from t)
    select event_id, case when te is null then 'running' when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm ' || (s % 60) || 's' else (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' end as text from s""")
def duration_text(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("te", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", scalars.duration_text("ts", "te").alias("text"))


@R.query("base64_md5", "select p_partkey, base64(cast(p_name as blob)) as b64, md5(p_name) as hash, regexp_replace(md5(p_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as uuid from part".replace("\\\\", "\\"))
def base64_md5(spark, d):
    return table(spark, d, "part").select("p_partkey", F.base64(F.col("p_name").cast("binary")).alias("b64"), F.md5(F.col("p_name").cast("binary")).alias("hash"), scalars.md5_uuid("p_name").alias("uuid"))


@R.query("instance_name_parse", "select p_partkey, printf('SM%d-%d (%dp)', p_size, p_partkey, p_size * 7) as name, case when p_partkey % 2 = 0 then p_size else -1 end as class from part")
def instance_name_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", scalars.instance_name("p_size", "p_partkey", F.col("p_size") * 7).alias("name"))
    shown = F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("x "), "name"))
    return p.select("p_partkey", "name", scalars.instance_class(shown).alias("class"))


@R.query("plain_double", "select c_custkey, regexp_replace(printf('%.6f', c_acctbal / 8), '(\\.[0-9]+?)0+$', '\\1') as text from customer")
def plain_double(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalars.plain_double(F.col("c_acctbal") / 8).alias("text"))


@R.query("robust_weights", "select l_orderkey, l_linenumber, count(*) as n, round(sum(exp(-0.5 * (l_discount / 0.05::double) ** 2)), 6) as welsch, round(sum(case when l_discount <= 0.05 then 1 else 0.05 / l_discount end), 6) as huber from lineitem group by all")
def robust_weights(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(scalars.welsch("l_discount", 0.05)), 6).alias("welsch"), F.round(F.sum(scalars.huber("l_discount", 0.05)), 6).alias("huber"))


_CUSTOMERS = "n as (select c_custkey + 10 as c_custkey, 'new ' || c_name as c_name, c_nationkey, c_acctbal, c_mktsegment from customer)"


def _new_customers(c):
    return c.withColumn("c_custkey", F.col("c_custkey") + 10).withColumn("c_name", F.concat(F.lit("new "), "c_name"))


@R.query("upsert_merge", f"with {_CUSTOMERS} select * from customer where c_custkey not in (select c_custkey from n) union all select * from n")
def upsert_merge(spark, d):
    c = table(spark, d, "customer")
    return store.upsert(c, _new_customers(c), ["c_custkey"])


@R.query("insert_ignore", f"with {_CUSTOMERS} select * from customer union all select * from n where c_custkey not in (select c_custkey from customer)")
def insert_ignore(spark, d):
    c = table(spark, d, "customer")
    return store.insert_ignore(c, _new_customers(c), ["c_custkey"])


@R.query("delete_cascade", """with g as (select id from point_clouds where deleted_at is not null) select 'point_clouds' as tab, count(*) as n from point_clouds where deleted_at is null
    union all select 'point_cloud_data', count(*) from point_cloud_data where cloud_id is null or cloud_id not in (select id from g) union all select 'label_definitions', count(*) from label_definitions where cloud_id is null or cloud_id not in (select id from g)""")
def delete_cascade(spark, d):
    names = ["point_clouds", "point_cloud_data", "label_definitions"]
    left = store.delete_cascade({n: table(spark, d, n) for n in names}, "point_clouds", F.col("deleted_at").isNotNull())
    out = None
    for n in names:
        one = left[n].agg(F.lit(n).alias("tab"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@R.query("cloud_blobs", "with c as (select distinct cloud_id, chunk_index, data from point_cloud_data where cloud_id is not null), f as (select cloud_id, chunk_index, min(data) as data from c group by all) select cloud_id, cast(sum(octet_length(data)) as bigint) as bytes from f group by cloud_id")
def cloud_blobs(spark, d):
    c = table(spark, d, "point_cloud_data").where("cloud_id is not null")
    return store.join_chunks(c, "cloud_id").select("cloud_id", F.length("data").cast("long").alias("bytes"))


@R.query("gather_scene", """with c as (select distinct id, project_id, name from point_clouds), l as (select cloud_id, count(distinct label_id) as n_labels from label_definitions group by 1), b as (select project_id, count(distinct id) as n_components from building_components group by 1)
    select c.id, c.name, coalesce(n_labels, 0) as n_labels, coalesce(n_components, 0) as n_components from c left join l on l.cloud_id = c.id left join b on b.project_id = c.project_id""")
def gather_scene(spark, d):
    c = table(spark, d, "point_clouds").select("id", "project_id", "name").distinct()
    n = table(spark, d, "label_definitions").groupBy(F.col("cloud_id").alias("id")).agg(F.count_distinct("label_id").alias("n_labels"))
    b = table(spark, d, "building_components").groupBy("project_id").agg(F.count_distinct("id").alias("n_components"))
    return c.join(n, "id", "left").join(b, "project_id", "left").select("id", "name", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("n_components", F.lit(0)).alias("n_components"))


@R.query("zbuffer_project", f"""with {PTS}, f as (select distinct label as node_id, label * 0.1::double as off from p),
    r as (select p.point_idx, f.node_id, p.z + 1.5::double as depth, cast(round((p.x + off) * 20 / (p.z + 1.5::double) + 16) as bigint) as u, cast(round(p.y * 20 / (p.z + 1.5::double) + 16) as bigint) as v from p, f where p.z + 1.5::double > 0 and p.z + 1.5::double <= 7),
    k as (select *, min(depth) over (partition by node_id, u, v) as zb from r where u between 0 and 31 and v between 0 and 31), s as (select point_idx, (u + v + node_id) % 5 as label, row_number() over (partition by point_idx order by node_id desc) as k from k where abs(depth - zb) <= 0.15::double)
    select p.point_idx, coalesce(s.label, 0) as label from p left join s on s.point_idx = p.point_idx and k = 1""")
def zbuffer_project(spark, d):
    from plumbline.operators import images

    p = points(spark, d)
    frames = p.select(F.col("label").alias("node_id")).distinct().select("node_id", F.array(*(F.lit(x).cast("double") for x in (1, 0, 0)), F.col("node_id") * F.lit(0.1), *(F.lit(x).cast("double") for x in (0, 1, 0, 0, 0, 0, 1, 1.5))).alias("view"),
                                             *(F.lit(v).alias(c) for c, v in (("fx", 20.0), ("fy", 20.0), ("cx", 16.0), ("cy", 16.0), ("width", 32), ("height", 32))))
    grid = spark.range(32 * 32).select((F.col("id") % 32).alias("u"), F.floor(F.col("id") / 32).alias("v"))
    labels = frames.select("node_id").crossJoin(grid).select("node_id", "u", "v", ((F.col("u") + F.col("v") + F.col("node_id")) % 5).alias("label"))
    return images.project_labels(p.drop("label"), frames, labels)


@R.query("force_orthogonal", f"with {PTS}, n as (select point_idx, x, y, z, x / sqrt(x*x+y*y) as a, y / sqrt(x*x+y*y) as b from p where abs(z / sqrt(x*x+y*y+z*z)) < 0.1) select point_idx, round(a, 6) as a, round(b, 6) as b, round(-(a*x + b*y), 6) as d from n")
def force_orthogonal(spark, d):
    p = points(spark, d)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    planes = p.withColumns({n: F.col(a) / r for n, a in zip("abc", "xyz")}).withColumn("d", F.lit(0.0)).where(geometry.plane_class() == "vertical")
    return geometry.force_orthogonal(planes).select("point_idx", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("d", 6).alias("d"))
