"""Deeply nested semi-structured records (problem 5).

Method: each body is parsed into a variant and exploded level by level: from the containers of one level come those of the
next, each with the key of its parent and its ordinal, until none is left. A merged schema, the union of the fields and kinds of each
level over all records, is inferred from the levels and tells the columns of each child table. All of it is built-in expressions over
one record at a time; no shuffle is needed. Nesting has no known depth (a property may hold parts that hold properties
again): STEPS levels are in the plan, and a body that goes deeper, or that the variant parser doesn't take (repeated keys, half surrogates,
no JSON), is walked in Arrow batches with an explicit stack, to the same result.

Every object is a node: `level` is its generic path (`sections[].properties[]`, the name of its child table),
`node_path` its exact one (`sections[1].properties[0]`), `parent_path` that of the object above it, `ordinal` its
position in its list. (record_id, node_path) is its surrogate key, (record_id, parent_path) that of its parent.
Scalars and arrays of scalars are its `attributes`, as JSON text, which keeps their type.

Defined results
* a body that is null, empty or no valid JSON gives no nodes, but a row in `rejected`;
* a body that is a list starts its paths with `[0]`; a lone object in place of a list named in `LISTS` is
  position 0; null entries are no nodes but count as positions; JSON inside a string is only text;
* of a key that stands twice in an object the last counts; redelivered records give their rows once;
* null record ids are kept; an empty table gives empty tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.jsontext import clean, parse, scalar_text
from plumbline.session import stage

#: Keys whose value is a list even if it stands there as a lone object.
LISTS = ("properties",)
NODES = "record_id bigint, level string, node_path string, parent_path string, list_key string, ordinal int, guid string, attributes map<string,string>"
#: Levels of containers (lists and objects count one each) in the plan; rows of an Arrow batch.
STEPS, _OUT = 12, 4_000


def walk(top, lists: tuple[str, ...]) -> Iterator[tuple]:
    """(level, node_path, parent_path, list_key, ordinal, object) of every object, parents first."""
    stack = [("", "", None, "", 0, top)]
    while stack:
        level, path, parent, key, ordinal, value = stack.pop()
        below = []
        if isinstance(value, dict):
            yield level, path, parent, key, ordinal, value
            for k, v in value.items():
                dot = "." if path else ""
                if isinstance(v, dict) and k in lists:
                    below.append((f"{level}{dot}{k}[]", f"{path}{dot}{k}[0]", path, k, 0, v))
                elif isinstance(v, (dict, list)):
                    below.append((f"{level}{dot}{k}", f"{path}{dot}{k}", path, k if isinstance(v, list) else "", 0, v))
        elif isinstance(value, list):
            below = [(f"{level}[]", f"{path}[{i}]", parent, key, i, v) for i, v in enumerate(value) if isinstance(v, (dict, list))]
            # an inner list's objects stand in that list, not in the one around it
            below = [x if isinstance(x[5], dict) else (*x[:3], "", *x[4:]) for x in below]
        stack.extend(reversed(below))


def _short(v):
    """Numbers in their shortest form, 3.0 as 3."""
    return int(v) if isinstance(v, float) and abs(v) < 1e15 and v.is_integer() else [_short(x) for x in v] if isinstance(v, list) else v


def _attributes(node: dict) -> list[tuple[str, str]]:
    return [(clean(k), clean(json.dumps(_short(v), ensure_ascii=False, separators=(",", ":")))) for k, v in node.items()
            if not isinstance(v, dict) and not (isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v))]


def _docs(records: DataFrame) -> DataFrame:
    """(record_id, body, doc) of the different bodies; `doc` is null where the variant parser doesn't take a body. It
    leaves text behind the first value unread, so a body is parsed as a field of an object with a last field of random name, which
    is only read if the body is one value and nothing else."""
    bodies = records.select(F.col("record_id").cast("long").alias("record_id"), "body").where("body is not null").distinct()
    half = F.col("body").rlike(r"\\u[dD][89a-fA-F]")
    last = uuid.uuid4().hex
    inside = F.try_parse_json(F.concat(F.lit('{"a":'), "body", F.lit(f',"{last}":0}}')))
    parsed = bodies.withColumn("v", F.when(~half, inside))
    return parsed.select("record_id", "body", F.when(F.try_variant_get("v", f"$.{last}", "int") == 0, F.try_variant_get("v", "$.a", "variant")).alias("doc"))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _item(level, path, parent, key, ordinal, obj: Column, list_: Column) -> Column:
    """A container; `obj` or `list` is null."""
    return F.struct(level.alias("level"), path.alias("path"), parent.alias("parent"), key.alias("key"), ordinal.cast("int").alias("ordinal"), obj.alias("obj"), list_.alias("list"))


def _below(item: Column, lists: tuple[str, ...]) -> Column:
    """The containers of a container. What is no container is dropped before anything else is worked out for it."""
    dot = F.when(item["path"] == "", "").otherwise(".")
    none = F.lit("")
    held = lambda k, v: F.struct(k.alias("k"), _object(v).alias("obj"), _list(v).alias("list"))
    only = lambda xs: F.filter(xs, lambda x: x["obj"].isNotNull() | x["list"].isNotNull())

    def field(x: Column) -> Column:
        lone = x["k"].isin(*lists) & x["obj"].isNotNull()
        more = lambda c, end: F.concat(item[c], dot, x["k"], F.when(lone, end).otherwise(none))
        key = F.when(lone | x["list"].isNotNull(), x["k"]).otherwise(none)
        return _item(more("level", F.lit("[]")), more("path", F.lit("[0]")), item["path"], key, F.lit(0), x["obj"], x["list"])

    def entry(x: Column) -> Column:
        # an inner list's objects stand in that list, not in the one around it
        key = F.when(x["obj"].isNotNull(), item["key"]).otherwise(none)
        return _item(F.concat(item["level"], F.lit("[]")), F.concat(item["path"], F.lit("["), x["k"].cast("string"), F.lit("]")), item["parent"], key, x["k"], x["obj"], x["list"])

    fields = F.transform(only(F.transform(F.map_entries(item["obj"]), lambda e: held(e["key"], e["value"]))), field)
    return F.coalesce(fields, F.transform(only(F.transform(F.coalesce(item["list"], F.array().cast("array<variant>")), lambda v, i: held(i, v))), entry))


def _row(item: Column, attributes: bool) -> Column:
    guid = item["obj"]["guid"]
    text = F.coalesce(F.try_variant_get(guid, "$", "string"), F.when(~F.is_variant_null(guid), F.to_json(guid)))
    cols = [item["level"].alias("level"), item["path"].alias("node_path"), item["parent"].alias("parent_path"), item["key"].alias("list_key"), item["ordinal"].alias("ordinal"), text.alias("guid")]
    if attributes:
        flat = lambda v: _object(v).isNull() & ~F.exists(F.coalesce(_list(v), F.array().cast("array<variant>")), lambda x: _object(x).isNotNull() | _list(x).isNotNull())
        cols.append(F.transform_values(F.map_filter(item["obj"], lambda _, v: flat(v)), lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))).alias("attributes"))
    return F.struct(*cols)


def nodes(records: DataFrame, lists: tuple[str, ...] = LISTS, attributes: bool = True) -> DataFrame:
    """All nodes of all valid bodies, one row each."""
    doc = F.col("doc")
    top = _item(F.lit(""), F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit(0), _object(doc), _list(doc))
    levels = _docs(records).select("record_id", "body", F.filter(F.array(top), lambda x: x["obj"].isNotNull() | x["list"].isNotNull()).alias("c0"), doc.isNull().alias("unread"))
    for d in range(1, STEPS + 1):  # one projection a level, so that each is worked out once
        levels = levels.withColumn(f"c{d}", F.flatten(F.transform(f"c{d - 1}", lambda x: _below(x, lists))))
    rows = [F.transform(F.filter(f"c{d}", lambda x: x["obj"].isNotNull()), lambda x: _row(x, attributes)) for d in range(STEPS)]
    walk_ = F.col("unread") | (F.size(f"c{STEPS}") > 0)
    # written once, so that neither part has the other's work done again
    done = stage(levels.select("record_id", F.when(~walk_, F.concat(*rows)).alias("n"), F.when(walk_, F.col("body")).alias("body")))
    shallow = done.select("record_id", F.explode("n").alias("n")).select("record_id", "n.*")
    walked = done.where("body is not null").select("record_id", "body").mapInArrow(_walker(lists, attributes), NODES)
    return shallow.unionByName(walked if attributes else walked.drop("attributes"))


def _walker(lists: tuple[str, ...], attributes: bool):
    schema = pa.schema([("record_id", pa.int64()), ("level", pa.string()), ("node_path", pa.string()), ("parent_path", pa.string()), ("list_key", pa.string()),
                        ("ordinal", pa.int32()), ("guid", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        rows: list[tuple] = []
        block = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        for batch in batches:
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    top = parse(body)
                except ValueError:
                    continue
                for level, path, parent, key, ordinal, node in walk(top, lists):
                    guid = node.get("guid")
                    rows.append((rid, clean(level), clean(path), None if parent is None else clean(parent), clean(key), ordinal,
                                 None if guid is None else scalar_text(guid), _attributes(node) if attributes else []))
                    if len(rows) >= _OUT:
                        yield block()
                        rows = []
        if rows:
            yield block()

    return run


def rejected(records: DataFrame) -> DataFrame:
    """(record_id, reason) of the bodies that are `null`, `empty` or `invalid`."""

    def run(batches):
        for batch in batches:
            ids, why = [], []
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if body is None or not body.strip():
                        raise ValueError
                    parse(body)
                except ValueError:
                    ids.append(rid)
                    why.append("null" if body is None else "invalid" if body.strip() else "empty")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(why, pa.string())], names=["record_id", "reason"])

    return records.select(F.col("record_id").cast("long").alias("record_id"), "body").distinct().mapInArrow(run, "record_id bigint, reason string").distinct()


def merged_schema(nodes_: DataFrame) -> DataFrame:
    """(level, field, kinds, n_nodes): the fields of each child table with every type they are seen with."""
    first = F.substring("value", 1, 1)
    shape = F.when(first == '"', "string").when(first == "[", "array").when(first.isin("t", "f"), "boolean").when(first == "n", None).otherwise("number")
    return nodes_.select("level", F.explode("attributes").alias("field", "value")).groupBy("level", "field").agg(
        F.sort_array(F.collect_set(shape)).alias("kinds"), F.count("*").alias("n_nodes"))


def child_table(nodes_: DataFrame, schema: DataFrame, level: str | None = None, list_key: str | None = None) -> DataFrame:
    """The flat table of one level, or of all objects that stand in lists of one key: keys, ordinal and one column per field of
    the merged schema (JSON strings unquoted). Fields named like a key column get a trailing underscore."""
    keys = ["record_id", "node_path", "parent_path", "ordinal"]
    ours = F.col("level") == level if level is not None else F.col("list_key") == list_key
    levels = nodes_.where(ours).select("level").distinct()
    fields = [r["field"] for r in schema.join(levels, "level", "left_semi").select("field").distinct().orderBy("field").collect()]
    text = lambda f: F.get_json_object(F.concat(F.lit('{"v":'), F.col("attributes")[f], F.lit("}")), "$.v")
    return nodes_.where(ours).select(*keys, *(text(f).alias(f + "_" * (f in keys)) for f in fields))


def properties(records: DataFrame) -> DataFrame:
    """(record_id, node_path, guid) of every object that stands in a `properties` list."""
    return nodes(records, attributes=False).where(F.col("list_key") == "properties").select(
        "record_id", "node_path", F.coalesce("guid", F.lit("")).alias("guid")).distinct()
