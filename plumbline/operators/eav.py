"""Attribute-value rows into wide tables (problem 7).

Method: the rows of each entity are resolved to field definitions and aggregated into one key-value map, the
known keys of which become typed columns; what does not fit its declared type is kept as a cast failure.

Defined results
* null or blank values are no values; rows without a definition (unknown keys, both keys null) are dropped;
* repeated rows count once; of several rows of a cell the latest `recorded_at` wins, then the larger row id, then the
  larger value;
* a cell whose winning value does not fit is null in its typed column; every value that did not fit, winning or
  not, makes the field appear in `cast_failures` (field -> the greatest such value);
* a field defined under several keys is one column; if its definitions disagree on the type, a value is judged by
  the definition of its own row and the column gets the type of the definition with the smallest id;
* rows with a null entity are dropped; empty tables give an empty result with all columns;
* more columns in either table do no harm: only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Definitions are sent to every executor; a larger table is joined by shuffle instead.
DEFINITIONS_BROADCAST_ROWS = 20_000

#: The declared types and what fits them.
INTEGER = r"^[+-]?[0-9]+$"
DOUBLE = r"^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$"
BOOLEAN = ["true", "false", "1", "0"]
TRISTATE = ["yes", "no", "unknown"]
ARRAYS = ["string_array", "enum_array", "object_array"]
OUTER_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
SQL_TYPES = {"integer": "bigint", "double": "double", "boolean": "boolean"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_BLANKS, "")


def is_json_array(text: Column) -> Column:
    """A valid JSON array and nothing else. The parser stops after the first value, so the text must parse both
    as an element and as a member: what ends one wrapper early breaks the other."""
    member = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return text.rlike(r"(?s)^\[.*\]$") & member.isNotNull() & element.isNotNull()


def fits(text: Column, kind: Column) -> Column:
    """Whether stripped text fits its declared type; unknown types take everything, like string."""
    low = F.lower(text)
    return (
        F.when(kind == "integer", text.rlike(INTEGER))
        .when(kind == "double", text.rlike(DOUBLE))
        .when(kind == "boolean", low.isin(BOOLEAN))
        .when(kind == "tristate", low.isin(TRISTATE))
        .when(kind.isin(ARRAYS), is_json_array(text))
        .otherwise(F.lit(True))
    )


def resolve(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(passport_id, field_name, kind, text, recorded_at, row_id) of every row that has a value and a definition."""
    d = definitions.select(
        F.col("id").alias("d_id"), F.col("leksikon_guid").alias("d_guid"), "field_name",
        F.lower(strip(F.col("type"))).alias("kind"),
    ).where("field_name is not null")
    by_id = d.where("d_id is not null").select(F.concat(F.lit("i"), "d_id").alias("k"), "d_id", "field_name", "kind")
    by_guid = d.where("d_guid is not null").select(F.concat(F.lit("g"), "d_guid").alias("k"), "d_id", "field_name", "kind")
    keys = by_id.unionByName(by_guid).groupBy("k").agg(F.min(F.struct("d_id", "field_name", "kind")).alias("d")).select("k", "d.field_name", "d.kind")
    if definitions.limit(DEFINITIONS_BROADCAST_ROWS + 1).count() <= DEFINITIONS_BROADCAST_ROWS:
        keys = F.broadcast(keys)
    rows = values.select(
        "passport_id", F.coalesce(F.concat(F.lit("i"), F.col("property_id")), F.concat(F.lit("g"), F.col("leksikon_guid"))).alias("k"),
        strip(F.decode(F.col("value"), "UTF-8")).alias("text"), "recorded_at", F.col("id").alias("row_id"),
    ).where((F.col("text") != "") & F.col("passport_id").isNotNull())
    return rows.join(keys, "k").drop("k")


def cells(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per entity and field: winning text, whether it fits, and the greatest value that did not."""
    rows = resolve(values, definitions).withColumn("ok", fits(F.col("text"), F.col("kind")))
    latest = F.struct("recorded_at", "row_id", "text", "ok")
    return rows.groupBy("passport_id", "field_name").agg(
        F.max(latest).alias("latest"), F.max(F.when(~F.col("ok"), F.col("text"))).alias("failure"), F.count("*").alias("n_rows"))


def entity_maps(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(passport_id, cells map<field, text that fits>, cast_failures map<field, text that does not>). The map of an
    entity has at most as many keys as there are fields, however many rows it has."""
    c = cells(values, definitions)
    pair = lambda v: F.struct(F.col("field_name").alias("key"), v.alias("value"))
    gather = lambda v: F.map_from_entries(F.filter(F.collect_list(pair(v)), lambda e: e["value"].isNotNull()))
    return c.groupBy("passport_id").agg(
        gather(F.when(F.col("latest.ok"), F.col("latest.text"))).alias("cells"), gather(F.col("failure")).alias("cast_failures"))


def typed(text: Column, kind: str) -> Column:
    if kind == "integer":
        return text.try_cast("bigint")
    if kind == "double":
        return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    if kind == "boolean":
        return F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False)
    if kind == "tristate":
        return F.lower(text)
    if kind == "string_array":
        return F.from_json(text, "array<string>")
    return text


def wide(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per entity, one typed column per defined field (sorted by name), and `cast_failures`."""
    fields = [
        (r["field_name"], r["d"]["kind"])
        for r in definitions.where("field_name is not null").groupBy("field_name")
        .agg(F.min(F.struct(F.col("id"), F.lower(strip(F.col("type"))).alias("kind"))).alias("d")).orderBy("field_name").collect()
    ]
    return entity_maps(values, definitions).select(
        "passport_id", *(typed(F.col("cells")[f], k).alias(f) for f, k in fields if f not in ("passport_id", "cast_failures")), "cast_failures")


def misfits(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(passport_id, field_name) of every cell with at least one value that does not fit its declared type."""
    return entity_maps(values, definitions).select("passport_id", F.explode(F.map_keys("cast_failures")).alias("field_name"))
