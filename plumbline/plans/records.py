"""Queries of the general problems on records: hierarchies, drift, nesting, orphans, attribute-value rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift, eav, hierarchy, nested, orphans
from plumbline.plans.registry import Registry
from plumbline.session import table

R = Registry()


@R.query("p1_found", """
    with recursive c as (select distinct id, parent_id from building_components where id is not null),
    v as (select id, parent_id as p from c where parent_id in (select id from c)),
    r as (select id, p as a from v union select r.id, v.p from r join v on v.id = r.a)
    select cast(min(a) as bigint) as cycle_id, id as component_id from r where a in (select id from r where id = a) group by id""")
def p1_found(spark, d):
    return hierarchy.looped(table(spark, d, "building_components"))


#: Every component once, loops cut at their smallest member, and the way from the root to each, as ids and names.
_FOREST = r"""with recursive c as (select id, case when parent_id <> -1 then cast(parent_id as bigint) end as p, name, row_number() over (partition by id order by created_at desc nulls last, case when parent_id <> -1 then parent_id end desc nulls last, name desc nulls last) as rn from building_components where id is not null),
    o as (select id, p, coalesce(replace(replace(name, '\', '\\'), '/', '\/'), '') as name from c where rn = 1), v as (select id, p from o where p in (select id from o)),
    l as (select id, p as a from v union select l.id, v.p from l join v on v.id = l.a), cut as (select id from l group by id having bool_or(a = id) and min(a) = id),
    t as (select id, id as root, [id] as way, name as path, p is not null and id not in (select id from v) as broken from o where id not in (select id from v) or id in (select id from cut)
        union all select o.id, t.root, list_append(t.way, o.id), t.path || '/' || o.name, false from t join o on o.p = t.id where o.id not in (select id from cut)),
    n as (select id, count(*) - 1 as descendants from (select unnest(way) as id from t) group by id),
    r as (select *, row_number() over (partition by root order by way) - 1 as ord from t)"""


@R.query("p1_paths", f"""{_FOREST} select r.id, path, len(way) - 1 as depth, root, 2 * ord - (len(way) - 1) as entry, 2 * ord - (len(way) - 1) + 2 * descendants + 1 as exit, descendants, root in (select id from cut) as looped, broken from r join n using (id)""")
def p1_paths(spark, d):
    t = hierarchy.stage(hierarchy.tour(table(spark, d, "building_components")))
    return t.join(hierarchy.paths(t), "id").select("id", "path", "depth", "root", "entry", "exit", "descendants", "looped", "broken")


@R.query("p1_descendants", f"""{_FOREST} select a as id, id as descendant, cast(len(way) - k as int) as hops from (select id, way, unnest(way) as a, generate_subscripts(way, 1) as k from t) where a <> id""")
def p1_descendants(spark, d):
    return hierarchy.descendants(hierarchy.tour(table(spark, d, "building_components")))


_CHANGES = """
    with o as (select distinct series_id, file_id, json_extract_string(payload, '$.node_id') as node, j.key as field, case when j.type = 'VARCHAR' then 'string' when j.type = 'BOOLEAN' then 'boolean' when j.type = 'ARRAY' then 'array'
            when j.type = 'OBJECT' then 'object' when j.type <> 'NULL' then 'number' end as kind, case when j.type <> 'NULL' then coalesce(try_cast(j.atom as double)::varchar, j.value::varchar) end as v
        from export_records, json_each(payload) j where json_valid(payload)),
    f as (select series_id, file_id, row_number() over (partition by series_id order by min(exported_at), file_id) as seq from export_records group by series_id, file_id),
    k as (select series_id, seq, field, list_sort(list_distinct(list(kind))) as kinds from o join f using (series_id, file_id) group by all),
    b as (select f.file_id, c.* from (select coalesce(a.series_id, p.series_id) as series_id, coalesce(a.seq, p.seq + 1) as seq, coalesce(a.field, p.field) as field, a.kinds as now, p.kinds as old
        from k a full join k p on a.series_id = p.series_id and a.seq = p.seq + 1 and a.field = p.field) c join f using (series_id, seq) where seq > 1),
    x as (select *, old is not null as gone from b where now is null or old is null),
    p as (select g.series_id, g.seq, g.field as fb, c.field as fa, count(*) as n from x g join x c on g.gone and not c.gone and g.series_id = c.series_id and g.seq = c.seq
        join f f1 on f1.series_id = g.series_id and f1.seq = g.seq - 1 join f f2 on f2.series_id = g.series_id and f2.seq = g.seq
        join o o1 on o1.series_id = g.series_id and o1.file_id = f1.file_id and o1.field = g.field and o1.v is not null join o o2 on o2.series_id = g.series_id and o2.file_id = f2.file_id and o2.field = c.field and o2.v is not null and o2.node = o1.node
        group by all having bool_and(o1.v = o2.v)),
    r as (select * from (select *, row_number() over (partition by series_id, seq, fb order by n desc, fa) as r1, row_number() over (partition by series_id, seq, fa order by n desc, fb) as r2 from p) where r1 = 1 and r2 = 1)
    select series_id, file_id, 'retyped' as change_kind, field as field_before, field as field_after from b where len(now) > 0 and len(old) > 0 and now <> old
    union all select x.series_id, file_id, 'removed', field, '' from x left join r on r.series_id = x.series_id and r.seq = x.seq and r.fb = x.field where gone and r.fb is null
    union all select x.series_id, file_id, 'added', '', field from x left join r on r.series_id = x.series_id and r.seq = x.seq and r.fa = x.field where not gone and r.fa is null
    union all select r.series_id, f.file_id, 'renamed', fb, fa from r join f using (series_id, seq)"""


@R.query("p4_found", _CHANGES)
def p4_found(spark, d):
    return drift.changes(table(spark, d, "export_records")).select("series_id", "file_id", "change_kind", "field_before", "field_after")


_PATHS = r"""
    with recursive f as (select series_id, file_id, row_number() over (partition by series_id order by min(exported_at), file_id) as seq from export_records group by series_id, file_id),
    o as (select distinct series_id, file_id, regexp_replace(ltrim(j.fullkey, '$.'), '\[[0-9]+\]', '[]', 'g') as path, case when j.type = 'VARCHAR' then 'string' when j.type = 'BOOLEAN' then 'boolean' when j.type = 'ARRAY' then 'array'
            when j.type = 'OBJECT' then 'object' when j.type <> 'NULL' then 'number' end as kind from export_records, json_tree(payload) j where json_valid(payload) and json_type(payload) = 'OBJECT' and j.type <> 'NULL' and j.fullkey <> '$'),
    k as (select series_id, seq, path, kind from o join f using (series_id, file_id)), b as (select series_id, seq + 1 as seq, path, kind from k)
    select series_id, file_id, path, kind, change from (select *, 'appears' as change from k anti join b using (series_id, seq, path, kind) where seq > 1 union all select *, 'goes' from b anti join k using (series_id, seq, path, kind)) join f using (series_id, seq)"""


@R.query("p4_paths", _PATHS.replace("with recursive", "with"))
def p4_paths(spark, d):
    return drift.path_changes(table(spark, d, "export_records"))


@R.query("p4_described", f"""with c as ({_CHANGES}), ft as (select series_id, file_id, min(exported_at) as t from export_records where series_id is not null and file_id is not null group by all),
    f as (select *, row_number() over (partition by series_id order by t, file_id) as seq from ft),
    v0 as (select distinct series_id, cast(version as varchar) as version, applied_at, description from schema_version where series_id is not null),
    v as (select v0.series_id, version, description, min(seq) as seq, ' ' || regexp_replace(lower(coalesce(description, '')), '[^a-z0-9_]+', ' ', 'g') || ' ' as words from v0 left join f on f.series_id = v0.series_id and f.t >= applied_at group by all),
    t as (select c.*, seq, version, description from c join f using (series_id, file_id) join v using (series_id, seq)
        where (field_before <> '' and contains(words, ' ' || lower(field_before) || ' ')) or (field_after <> '' and contains(words, ' ' || lower(field_after) || ' ')))
    select distinct series_id, file_id, change_kind, field_before, field_after, version, description, 'described' as status from t
    union all select *, null, null, 'undescribed' from (select * from c except select series_id, file_id, change_kind, field_before, field_after from t)
    union all select distinct series_id, null, null, null, null, version, description, 'entry_only' from v where not exists (select 1 from t where t.series_id = v.series_id and t.seq = v.seq and t.version is not distinct from v.version and t.description is not distinct from v.description)""")
def p4_described(spark, d):
    return drift.described(table(spark, d, "export_records"), table(spark, d, "schema_version"))


@R.query("p4_unified")
def p4_unified(spark, d):
    return drift.unified(table(spark, d, "export_records"))


@R.query("p5_found", r"""
    with b as (select distinct record_id, body from passport_records where json_valid(body)), t as (select record_id, j.fullkey as path, j.value as v from b, json_tree(body) j where j.type = 'OBJECT'),
    p as (select record_id, regexp_replace(regexp_replace(path, '\.properties(\.|$)', '.properties[0]\1', 'g'), '\.properties(\.|$)', '.properties[0]\1', 'g') as path, v from t where regexp_matches(path, '\.properties(\[[0-9]+\])?$'))
    select distinct record_id, regexp_replace(path, '^\$\.?', '') as node_path, coalesce(json_extract_string(v, '$.guid'), '') as guid from p""")
def p5_found(spark, d):
    return nested.properties(table(spark, d, "passport_records"))


#: All objects with their normal paths; a lone object in place of a list of properties stands in it at 0.
_NODES = r"""b as (select distinct record_id, body from passport_records where json_valid(body)),
    t as (select record_id, regexp_replace(regexp_replace(regexp_replace(j.fullkey, '^\$\.?', ''), '(^|\.)properties(\.|$)', '\1properties[0]\2', 'g'), '(^|\.)properties(\.|$)', '\1properties[0]\2', 'g') as p, j.value as v from b, json_tree(body) j where j.type = 'OBJECT'),
    n as (select record_id, replace(regexp_replace(p, '\[[0-9]+\]', '[]', 'g'), '"', '') as level, replace(p, '"', '') as node_path, case when regexp_matches(p, '^(\[[0-9]+\])*$') then null else regexp_replace(replace(p, '"', ''), '\.?[^.\[\]]+(\[[0-9]+\])*$', '') end as parent_path,
        regexp_extract(p, '([^.\[\]]+)\[[0-9]+\]$', 1) as list_key, coalesce(try_cast(regexp_extract(p, '\[([0-9]+)\]$', 1) as int), 0) as ordinal, json_extract_string(v, '$.guid') as guid, v from t),
    a as (select record_id, level, node_path, j.key as field, j.type as type, j.value as value from n, json_each(v) j where j.type <> 'OBJECT' and not (j.type = 'ARRAY' and len(list_filter(json_extract(j.value, '$[*]'), lambda x: json_type(x) in ('OBJECT', 'ARRAY'))) > 0))"""


@R.query("p5_nodes", f"with {_NODES} select record_id, level, node_path, parent_path, list_key, ordinal, guid from n")
def p5_nodes(spark, d):
    return nested.nodes(table(spark, d, "passport_records"), attributes=False)


@R.query("p5_schema", f"""with {_NODES} select level, field, array_to_string(list_sort(list_distinct(list(case when type = 'VARCHAR' then 'string' when type = 'ARRAY' then 'array' when type = 'BOOLEAN' then 'boolean' when type = 'NULL' then null else 'number' end))), ',') as kinds,
    count(*) as n_nodes from a group by level, field""")
def p5_schema(spark, d):
    return nested.merged_schema(nested.nodes(table(spark, d, "passport_records"))).withColumn("kinds", F.array_join("kinds", ","))


def _flat(spark, d, list_key):
    n = nested.stage(nested.nodes(table(spark, d, "passport_records")))
    return nested.child_table(n, nested.merged_schema(n), list_key=list_key)


def _flat_sql(list_key, *fields):
    pick = ", ".join(f"max(case when a.field = '{f}' then regexp_replace(json_extract_string(a.value, '$'), case when a.type = 'DOUBLE' then '[.]0+$' else '^$' end, '') end) as \"{f}\"" for f in fields)
    return f"with {_NODES} select n.record_id, n.node_path, n.parent_path, n.ordinal, {pick} from n left join a using (record_id, node_path) where list_key = '{list_key}' group by all"


@R.query("p5_sections", _flat_sql("sections", "nameDK", "nameEN", "properties"))
def p5_sections(spark, d):
    return _flat(spark, d, "sections")


@R.query("p5_properties", _flat_sql("properties", "guid", "name", "value", "values"))
def p5_properties(spark, d):
    return _flat(spark, d, "properties")


def _orphans(spark, d):
    return orphans.cascade({n: table(spark, d, n) for r in orphans.PROJECT_REFERENCES for n in (r.child, r.parent)})


_CLOUD_ORPHANS = """
    select '{t}' as child_table, cloud_id as ref_id, cast({no} as bigint) as child_no, strftime(recorded_at, '%Y-%m') as period_ym,
        case when p.id is null then 'missing' when recorded_at > deleted then 'deleted' else 'late' end as orphan_kind
    from {t} left join p on p.id = cloud_id
    where cloud_id is not null and (p.id is null or recorded_at > deleted or recorded_at < created)"""


_DIRECT = f"""
    p as (select id, min(created_at) as created, case when count(*) = count(deleted_at) then max(deleted_at) end as deleted from point_clouds group by id),
    b as (select id, min(created_at) as created from building_components group by id),
    x as ({_CLOUD_ORPHANS.format(t="point_cloud_data", no="chunk_index")}
    union all {_CLOUD_ORPHANS.format(t="label_definitions", no="label_id")}
    union all
    select 'building_components', c.parent_id, c.id, strftime(c.created_at, '%Y-%m'), case when b.id is null then 'missing' else 'late' end
    from building_components c left join b on b.id = c.parent_id where c.parent_id <> -1 and (b.id is null or c.created_at < b.created))"""

#: The distance of a component to the nearest direct orphan above it, step by step.
_CASCADE = f"""with recursive {_DIRECT},
    l as (select distinct id, parent_id as up from building_components where id is not null and parent_id is not null and parent_id <> -1),
    k as (select child_no as id, min(orphan_kind) as kind from x where child_table = 'building_components' and child_no is not null group by child_no),
    s as (select id, kind, 0 as hops from k union select l.id, s.kind, s.hops + 1 from s join l on l.up = s.id where l.id not in (select id from k) and s.hops < 10000),
    n as (select id, min(hops) as hops, arg_min(kind, (hops, kind)) as kind from s group by id),
    w as (select distinct * from (select child_table, ref_id, child_no, period_ym, orphan_kind, 'direct' as origin, 0 as hops from x
        union all select 'building_components', c.parent_id, c.id, strftime(c.created_at, '%Y-%m'), n.kind, 'inherited', n.hops + 1 from building_components c join n on n.id = c.parent_id
        where (c.parent_id, c.id) not in (select ref_id, child_no from x where child_table = 'building_components' and child_no is not null)))"""


@R.query("p6_found", f"with {_DIRECT} select distinct * from x")
def p6_found(spark, d):
    return _orphans(spark, d).where("origin = 'direct'").select("child_table", "ref_id", "child_no", "period_ym", "orphan_kind")


@R.query("p6_cascade", f"{_CASCADE} select * from w")
def p6_cascade(spark, d):
    return _orphans(spark, d)


@R.query("p6_periods", f"{_CASCADE} select child_table, period_ym, orphan_kind, origin, count(*) as n_orphans from w group by all")
def p6_periods(spark, d):
    return _orphans(spark, d).groupBy("child_table", "period_ym", "orphan_kind", "origin").agg(F.count("*").alias("n_orphans"))


@R.query("p7_found", r"""
    with d as (select id, leksikon_guid as g, field_name, lower(trim(type)) as kind from property_definitions),
    v as (select passport_id, property_id, leksikon_guid, regexp_replace(decode(value), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as x from passport_property_values where value is not null),
    r as (select passport_id, field_name, kind, x from v join d on v.property_id = d.id
        union all select passport_id, field_name, kind, x from v join d on v.property_id is null and v.leksikon_guid = d.g)
    select distinct passport_id, field_name from r where x <> '' and not case
        when kind = 'integer' then regexp_full_match(x, '[+-]?[0-9]+')
        when kind = 'double' then regexp_full_match(x, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?')
        when kind = 'boolean' then lower(x) in ('true', 'false', '1', '0')
        when kind = 'tristate' then lower(x) in ('yes', 'no', 'unknown')
        when kind in ('string_array', 'enum_array', 'object_array') then json_valid(x) and starts_with(x, '[')
        else true end""")
def p7_found(spark, d):
    return eav.misfits(table(spark, d, "passport_property_values"), table(spark, d, "property_definitions"))


@R.query("p7_cells", r"""
    with d as (select id, leksikon_guid as g, field_name, lower(regexp_replace(type, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as kind from property_definitions where field_name is not null),
    k as (select key, unnest(min(d)) from (select 'i' || id as key, {'id': id, 'field_name': field_name, 'kind': kind} as d from d where id is not null union all select 'g' || g, {'id': id, 'field_name': field_name, 'kind': kind} from d where g is not null) group by key),
    v as (select id as row_id, passport_id, recorded_at, coalesce('i' || property_id, 'g' || leksikon_guid) as key, regexp_replace(decode(value), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as x from passport_property_values where value is not null and passport_id is not null),
    r as (select passport_id, field_name, recorded_at, row_id, x, case when kind = 'integer' then regexp_full_match(x, '[+-]?[0-9]+') when kind = 'double' then regexp_full_match(x, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?')
        when kind = 'boolean' then lower(x) in ('true', 'false', '1', '0') when kind = 'tristate' then lower(x) in ('yes', 'no', 'unknown') when kind in ('string_array', 'enum_array', 'object_array') then json_valid(x) and starts_with(x, '[') else true end as ok
        from v join k using (key) where x <> ''),
    w as (select *, row_number() over (partition by passport_id, field_name order by recorded_at desc nulls last, row_id desc nulls last, x desc, ok desc) as rn from r)
    select passport_id, field_name, max(case when rn = 1 and ok then x end) as text, max(case when not ok then x end) as failure, count(*) as n_rows from w group by all""")
def p7_cells(spark, d):
    c = eav.cells(table(spark, d, "passport_property_values"), table(spark, d, "property_definitions"))
    return c.select("passport_id", "field_name", F.when(F.col("latest.ok"), F.col("latest.text")).alias("text"), "failure", "n_rows")


@R.query("p7_wide")
def p7_wide(spark, d):
    w = eav.wide(table(spark, d, "passport_property_values"), table(spark, d, "property_definitions"))
    return w.withColumn("cast_failures", F.to_json("cast_failures"))
