"""Material passports between JSON documents and attribute-value rows.

A document has sections with a name and properties; a property has a name, a guid and a `value`, a list of `values`, or, for a list of
objects, one entry per object with `properties` of its own. Field lists are data (property_definitions), not code.

Reading is lenient: what doesn't fit its type becomes null with the text kept in `rejected`. With strict=True it is an error.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.jsontext import parse
from plumbline.operators.eav import fits, strip, typed


def decode(text: Column, kind: Column) -> Column:
    """Whether a stored text is null or fits its declared type (integer, double, boolean, tristate, arrays)."""
    return text.isNull() | fits(strip(text), F.lower(strip(kind)))


def typed_values(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (passport_id, field_name, kind, text) with typed columns as_integer, as_double, as_boolean, as_tristate, as_strings, and `rejected`. Blank text is
    null; an unknown tristate counts as `unknown`, with the text rejected."""
    text = F.when(F.length(strip(F.col("text"))) > 0, strip(F.col("text")))
    kind = F.lower(strip(F.col("kind")))
    ok = decode(text, kind)
    out = rows.withColumn("_t", text).withColumn("_k", kind).withColumn("_ok", ok)
    if strict:
        out = out.withColumn("_ok", F.when(F.col("_ok"), True).otherwise(F.raise_error(F.concat(F.lit("not fitting: "), F.col("field_name"), F.lit(" = "), F.col("_t"))).cast("boolean")))
    good = F.when(F.col("_ok"), F.col("_t"))
    cols = {f"as_{n}": F.when(F.col("_k") == k, typed(good, k)) for n, k in (("integer", "integer"), ("double", "double"), ("boolean", "boolean"))}
    cols["as_tristate"] = F.when((F.col("_k") == "tristate") & F.col("_t").isNotNull(), F.coalesce(F.lower(good), F.lit("unknown")))
    cols["as_strings"] = F.when(F.col("_k").isin("string_array", "enum_array"), F.from_json(good, "array<string>"))
    return out.withColumns(cols | {"rejected": F.when(~F.col("_ok"), F.col("_t"))}).drop("_t", "_k", "_ok")


def _entries(doc: dict):
    """(section, name, guid, text) of a document's properties; lists as JSON."""
    for section in doc.get("sections") or []:
        if not isinstance(section, dict):
            continue
        lists: dict[tuple, list] = {}
        props = section.get("properties") or []
        for p in [props] if isinstance(props, dict) else props:
            if not isinstance(p, dict) or "name" not in p:
                continue
            key = (section.get("nameEN"), p["name"], p.get("guid"))
            if "properties" in p:
                inner = {q["name"]: q.get("value", "") for q in p["properties"] or [] if isinstance(q, dict) and "name" in q}
                lists.setdefault(key, [])
                if any(v not in ("", None) for v in inner.values()):  # an entry with nothing filled in is the template
                    lists[key].append(inner)
            elif "values" in p:
                yield *key, json.dumps([v["value"] for v in p["values"] or [] if isinstance(v, dict) and "value" in v], ensure_ascii=False)
            else:
                v = p.get("value")
                yield *key, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        for key, objects in lists.items():
            yield *key, json.dumps(objects, ensure_ascii=False)


def from_json(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(properties, logs) of documents (record_id, body), each body an object or a list of them. Properties are (record_id, document, document_guid, section, name,
    guid, text, sort_order); logs (record_id, document, n, type, guid, edited_by, edited_date, old_value, new_value). Bodies that are no JSON are passed over."""

    def documents_in(body):
        try:
            top = parse(body) if body else None
        except ValueError:
            return []
        return [x for x in (top if isinstance(top, list) else [top]) if isinstance(x, dict)]

    def flat(value) -> dict:
        """An object, or a list of name-value entries, as a dict of texts."""
        if isinstance(value, list):
            value = {e["name"]: e.get("value") for e in value if isinstance(e, dict) and "name" in e}
        return {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in value.items()} if isinstance(value, dict) else {}

    def props(parts):
        for f in parts:
            out = []
            for rid, body in zip(f.record_id, f.body):
                for n, doc in enumerate(documents_in(body)):
                    guid = flat(doc.get("metadata")).get("document guid")
                    out += [(rid, n, guid, *e, k) for k, e in enumerate(_entries(doc))]
            yield pd.DataFrame(out, columns=["record_id", "document", "document_guid", "section", "name", "guid", "text", "sort_order"])

    def logs(parts):
        fields = ["type", "guid", "edited by", "edited date", "old value", "new value"]
        for f in parts:
            out = []
            for rid, body in zip(f.record_id, f.body):
                for n, doc in enumerate(documents_in(body)):
                    for k, e in enumerate(doc.get("log") or []):
                        got = flat(e.get("properties", e)) if isinstance(e, dict) else {}
                        out.append((rid, n, k, *(got.get(x) for x in fields)))
            yield pd.DataFrame(out, columns=["record_id", "document", "n", *(x.replace(" ", "_") for x in fields)])

    d = documents.select("record_id", "body")
    return (d.mapInPandas(props, "record_id long, document int, document_guid string, section string, name string, guid string, text string, sort_order int"),
            d.mapInPandas(logs, "record_id long, document int, n int, type string, guid string, edited_by string, edited_date string, old_value string, new_value string"))


def to_json(values: DataFrame, definitions: DataFrame, filled: str = "all", defaults: Sequence[str] = ()) -> DataFrame:
    """(passport_id, document): each passport (passport_id, field_name, text) as a JSON document with all defined fields, by category and definition order.

    An empty list of strings is `"value": ""`, an empty list of enums `"values": []`, an empty list of objects one blank entry; `filled` is
    `all`, or `blank` for a template; `defaults` are boolean fields that are false where unset."""
    d = definitions.select(F.col("id").alias("d_id"), "field_name", "name_en", "category", F.col("leksikon_guid").alias("guid"), F.lower(strip(F.col("type"))).alias("kind"))
    d = d.groupBy("field_name").agg(F.min(F.struct("d_id", "name_en", "category", "guid", "kind")).alias("d")).select("field_name", "d.*")
    grid = values.select("passport_id").distinct().crossJoin(F.broadcast(d))  # definitions are a fixed table of some dozen rows
    if d.limit(10_001).count() > 10_000:
        raise ValueError("too many definitions for one document")
    got = values.select("passport_id", "field_name", "text")
    j = grid.join(got, ["passport_id", "field_name"], "left") if filled == "all" else grid.withColumn("text", F.lit(None).cast("string"))
    if defaults:
        j = j.withColumn("text", F.when(F.col("field_name").isin(list(defaults)), F.coalesce("text", F.lit("false"))).otherwise(F.col("text")))
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("v"))), 6, 1 << 30)
    text = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    j = j.withColumn("_name", quoted(F.coalesce("name_en", "field_name"))).withColumn("_guid", quoted(F.coalesce("guid", F.lit("")))).withColumn("_text", quoted(F.coalesce("text", F.lit(""))))
    head = F.concat(F.lit('{"name":'), text("_name"), F.lit(',"guid":'), text("_guid"))
    items = F.coalesce(F.from_json("text", "array<string>"), F.array().cast("array<string>"))
    wrapped = F.to_json(F.transform(items, lambda x: F.struct(x.alias("value"))))
    with_guid = F.to_json(F.transform(items, lambda x: F.struct(x.alias("value"), F.lit("").alias("guid"))))
    objects = F.coalesce(F.from_json("text", "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    one = lambda o: F.to_json(F.transform(F.map_entries(o), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
    several = F.when(F.size(objects) == 0, F.concat(head, F.lit(',"properties":[]}'))).otherwise(F.array_join(F.transform(objects, lambda o: F.concat(head, F.lit(',"properties":'), one(o), F.lit("}"))), ","))
    prop = (
        F.when(F.col("kind") == "object_array", several)
        .when((F.col("kind") == "enum_array"), F.concat(head, F.lit(',"values":'), F.when(F.size(items) == 0, "[]").otherwise(with_guid), F.lit("}")))
        .when((F.col("kind") == "string_array") & (F.size(items) > 0), F.concat(head, F.lit(',"values":'), wrapped, F.lit("}")))
        .otherwise(F.concat(head, F.lit(',"value":'), text("_text"), F.lit("}")))
    )
    section = j.withColumn("_p", prop).groupBy("passport_id", "category").agg(F.min("d_id").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d_id", "_p"))), lambda s: s["_p"]), ",").alias("_ps"))
    section = section.withColumn("_c", quoted(F.coalesce("category", F.lit("")))).withColumn("_s", F.concat(F.lit('{"nameEN":'), text("_c"), F.lit(',"properties":['), F.col("_ps"), F.lit("]}")))
    return section.groupBy("passport_id").agg(F.concat(F.lit('{"sections":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "_s"))), lambda s: s["_s"]), ","), F.lit("]}")).alias("document"))
