"""Queries of the problems on texts and on what people typed."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm import addresses, leakage, names, spans, tokenizer
from plumbline.plans.registry import Registry
from plumbline.session import table

R = Registry()


@R.query("p2_found")
def p2_found(spark, d):
    return addresses.same_place_pairs(table(spark, d, "projects"))


@R.query("p2_places")
def p2_places(spark, d):
    return addresses.project_places(table(spark, d, "projects"))


def _spellings(spark, d):
    return names.field_spellings(*(table(spark, d, n) for n in ("projects", "passport_property_values", "property_definitions")))


@R.query("p3_found")
def p3_found(spark, d):
    return names.same_name_pairs(_spellings(spark, d))


@R.query("p3_classes")
def p3_classes(spark, d):
    c = names.name_classes(_spellings(spark, d))
    return c.select("spelling", F.md5("name").alias("class_id"))


@R.query("p8_ids")
def p8_ids(spark, d):
    return tokenizer.token_ids(table(spark, d, "documents"))


_LEAKS = r"""
    i as (select distinct item_id as id, regexp_extract_all(text, '[\p{L}\p{Nd}]+') as w from eval_items where text is not null),
    d as (select doc_id as id, regexp_extract_all(text, '[\p{L}\p{Nd}]+') as w from documents where text is not null),
    a as (select id, lower(array_to_string(w[k:k + 11], ' ')) as g from (select id, w, unnest(generate_series(1, len(w) - 11)) as k from i)),
    b as (select id, k, lower(array_to_string(w[k:k + 11], ' ')) as g from (select id, w, unnest(generate_series(1, len(w) - 11)) as k from d))"""


@R.query("p9_found", f"with {_LEAKS} select distinct a.id as item_id, b.id as doc_id from a join b using (g)")
def p9_found(spark, d):
    return leakage.leaks(table(spark, d, "eval_items"), table(spark, d, "documents"))


@R.query("p9_removal_spans", f"""with {_LEAKS}, m as (select distinct b.id as doc_id, k, a.id as item_id from a join b using (g)), p as (select distinct doc_id, k from m),
    n as (select *, case when k <= lag(k) over (partition by doc_id order by k) + 12 then 0 else 1 end as new from p), r as (select *, sum(new) over (partition by doc_id order by k) as r from n)
    select doc_id, min(k) - 1 as word_from, max(k) + 11 as word_to, count(distinct item_id) as n_items from r join m using (doc_id, k) group by doc_id, r""")
def p9_removal_spans(spark, d):
    return leakage.removal_spans(table(spark, d, "eval_items"), table(spark, d, "documents"))


_SHARED = """w as (select doc_id, k, substring(text, k, 150) as g from (select doc_id, text, unnest(generate_series(1, length(text) - 149)) as k from documents)),
    s as (select g from w group by g having min(doc_id) <> max(doc_id)), h as (select distinct doc_id, k from w join s using (g))"""


@R.query("p10_found", f"with {_SHARED} select distinct doc_id from h")
def p10_found(spark, d):
    return spans.sharing_documents(table(spark, d, "documents"))


@R.query("p10_spans", f"""with {_SHARED}, n as (select *, case when k <= lag(k) over (partition by doc_id order by k) + 150 then 0 else 1 end as new from h),
    r as (select *, sum(new) over (partition by doc_id order by k) as r from n) select doc_id, min(k) - 1 as char_from, max(k) + 149 as char_to from r group by doc_id, r""")
def p10_spans(spark, d):
    return spans.shared_spans(table(spark, d, "documents"))
