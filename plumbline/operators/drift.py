"""Schemas that drift between files (problem 4).

Method: tagged-union inference. The schema of each file is the set of its fields with every type a field is seen
with; all files' schemas are fused without giving up alternatives. Conflicting types become typed branches
(`as_number`, `as_boolean`, ...) beside one canonical text, and each alternative, name or type, that appears or
goes between two neighbouring files of a series is reported.

Defined results
* files of a series are ordered by `exported_at`, then `file_id`; a file delivered twice counts once;
* a file has a field if one of its records has the key, be it null; nulls have no type, so a field that is all null
  on one side is not retyped;
* a removed field `a` and an added field `b` are one renamed field if every node that has a value for both (`a` in the
  earlier file, `b` in the later one) has the same, and there is at least one; of several partners the one with more
  such nodes, then the smaller name, is taken, and only if both sides choose each other;
* several types of a field in one file: the set of types is compared;
* changes at nested paths are told alternative by alternative (`path_changes`), and beside the version table's entries (`described`);
* rows with a null series or file, and payloads that are no JSON object, are left out (the file still counts as one);
* empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stage


def _kind(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (F.when(t == "VOID", None).when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array")
            .when(t.startswith("OBJECT"), "object").otherwise("number"))


def _canonical(v: Column, kind: Column) -> Column:
    """One text for what is the same value in other clothes: numbers by value, a one-element array or an object with
    a `value` by what it holds."""
    number = F.when(kind == "number", v.cast("double").cast("string"))
    text = lambda x: F.coalesce(F.try_variant_get(x, "$", "double").cast("string"), F.try_variant_get(x, "$", "string"))
    inner_array = F.when((kind == "array") & F.try_variant_get(v, "$[1]", "variant").isNull(), text(F.try_variant_get(v, "$[0]", "variant")))
    inner_object = F.when(kind == "object", text(F.try_variant_get(v, "$.value", "variant")))
    return F.coalesce(number, inner_array, inner_object, F.when(kind == "string", F.coalesce(v.cast("string").try_cast("double").cast("string"), v.cast("string"))), F.when(kind.isNotNull(), F.to_json(v)))


def observations(records: DataFrame) -> DataFrame:
    """(series_id, file_id, row_no, node_id, field, kind, canonical, raw) of every key of every record."""
    r = records.where("series_id is not null and file_id is not null").select("series_id", "file_id", "row_no", F.try_parse_json("payload").alias("doc"))
    r = r.where(F.schema_of_variant("doc").startswith("OBJECT"))
    node = F.try_variant_get("doc", "$.node_id", "string").alias("node_id")
    spark = records.sparkSession
    e = r.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select("series_id", "file_id", "row_no", node, F.col("key").alias("field"), F.col("value").alias("v"))
    e = e.withColumn("kind", _kind(F.col("v")))
    return e.select("series_id", "file_id", "row_no", "node_id", "field", "kind", _canonical(F.col("v"), F.col("kind")).alias("canonical"), F.when(F.col("kind").isNotNull(), F.to_json("v")).alias("raw"))


def path_kinds(records: DataFrame, levels: int = 16) -> DataFrame:
    """(series_id, file_id, path, kind): the tagged union of each file at every nested path, such as `height.value` or `tags[]`; arrays and objects are
    kinds themselves. Paths below `levels` levels are told by the kind of the last one only."""
    r = records.where("series_id is not null and file_id is not null").select("series_id", "file_id", F.try_parse_json("payload").alias("doc"))
    none = F.array().cast("array<variant>")
    item = lambda path, v: F.struct(path.alias("path"), v.alias("v"))

    def below(x: Column) -> Column:
        fields = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: item(F.concat(x["path"], F.when(x["path"] == "", "").otherwise("."), e["key"]), e["value"]))
        return F.coalesce(fields, F.transform(F.coalesce(F.try_variant_get(x["v"], "$", "array<variant>"), none), lambda v: item(F.concat(x["path"], F.lit("[]")), v)))

    r = r.where(F.schema_of_variant("doc").startswith("OBJECT")).withColumn("c0", F.array(item(F.lit(""), F.col("doc"))))
    for d in range(1, levels + 1):  # one projection a level
        r = r.withColumn(f"c{d}", F.flatten(F.transform(f"c{d - 1}", below)))
    kinds = F.concat(*(F.transform(f"c{d}", lambda x: F.struct(x["path"].alias("path"), _kind(x["v"]).alias("kind"))) for d in range(1, levels + 1)))
    return r.select("series_id", "file_id", F.explode(F.array_distinct(kinds)).alias("x")).select("series_id", "file_id", "x.path", "x.kind").where("kind is not null").distinct()


def path_changes(records: DataFrame) -> DataFrame:
    """(series_id, file_id, path, kind, change): each alternative (kind at a nested path) that a file has and the one before it in its series hasn't
    (`appears`), or the other way round (`goes`)."""
    files = stage(file_order(records))
    k = stage(path_kinds(records).join(files, ["series_id", "file_id"]).select("series_id", "seq", "path", "kind"))
    step = ["series_id", "seq", "path", "kind"]
    before = k.withColumn("seq", F.col("seq") + 1)
    appears = k.where("seq > 1").join(before, step, "left_anti").withColumn("change", F.lit("appears"))
    goes = before.join(k, step, "left_anti").withColumn("change", F.lit("goes"))
    return appears.unionByName(goes).join(files, ["series_id", "seq"]).select("series_id", "file_id", "path", "kind", "change")


def described(records: DataFrame, versions: DataFrame) -> DataFrame:
    """Changes beside the entries of the version table that tell them: (series_id, file_id, change_kind, field_before, field_after, version, description,
    status). An entry (columns series_id, version, applied_at, description) belongs to the first file exported at or after it was applied, and tells a change if its description has the name of
    the field before or after it as a word. `status` is `described`, `undescribed` for a change without an entry that tells it, `entry_only` for an
    entry that tells no change (the columns of the other side are null then). Repeated entries count once."""
    at = records.where("series_id is not null and file_id is not null").groupBy("series_id", "file_id").agg(F.min("exported_at").alias("at"))
    files = stage(at.select("series_id", "file_id", "at", F.row_number().over(Window.partitionBy("series_id").orderBy("at", "file_id")).cast("long").alias("seq")))
    v = versions.where("series_id is not null").select("series_id", F.col("version").cast("string").alias("version"), "applied_at", "description").distinct()
    # entries and files of a series in one order of time; an entry before a file of the same time
    line = v.select("series_id", F.col("applied_at").alias("at"), F.lit(0).alias("is_file"), F.lit(None).cast("long").alias("seq"), "version", "description").unionByName(
        files.select("series_id", "at", F.lit(1).alias("is_file"), "seq", F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("description")))
    after = Window.partitionBy("series_id").orderBy("at", "is_file", "seq").rowsBetween(0, Window.unboundedFollowing)
    v = line.withColumn("to", F.first("seq", ignorenulls=True).over(after)).where("is_file = 0").select("series_id", F.col("to").alias("seq"), "version", "description")
    v = stage(v.withColumn("words", F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce("description", F.lit(""))), "[^a-z0-9_]+", " "), F.lit(" "))))
    c = stage(changes(records).select("series_id", "file_id", "change_kind", "field_before", "field_after").join(files.select("series_id", "file_id", "seq"), ["series_id", "file_id"]))
    said = lambda f: (F.col(f) != "") & F.col("words").contains(F.concat(F.lit(" "), F.lower(f), F.lit(" ")))
    told = stage(c.join(v, ["series_id", "seq"]).where(said("field_before") | said("field_after")))
    cols = ["series_id", "file_id", "change_kind", "field_before", "field_after", "version", "description", "status"]
    null = lambda d, *names: d.withColumns({n: F.lit(None).cast("string") for n in names})
    one = told.withColumn("status", F.lit("described"))
    two = null(c.join(told.select("series_id", "file_id", "change_kind", "field_before", "field_after").distinct(), ["series_id", "file_id", "change_kind", "field_before", "field_after"], "left_anti"), "version", "description").withColumn("status", F.lit("undescribed"))
    key = [v[k].eqNullSafe(told[k]) for k in ("series_id", "seq", "version", "description")]
    three = null(v.join(told, key[0] & key[1] & key[2] & key[3], "left_anti"), "file_id", "change_kind", "field_before", "field_after").withColumn("status", F.lit("entry_only"))
    return one.select(*cols).unionByName(two.select(*cols)).unionByName(three.select(*cols)).distinct()


def file_order(records: DataFrame) -> DataFrame:
    """(series_id, file_id, seq): the position of each file in its series, from 1. One row per file is sorted, not
    one per record."""
    files = records.where("series_id is not null and file_id is not null").groupBy("series_id", "file_id").agg(F.min("exported_at").alias("at"))
    return files.select("series_id", "file_id", F.row_number().over(Window.partitionBy("series_id").orderBy("at", "file_id")).cast("long").alias("seq"))


def file_schemas(obs: DataFrame, files: DataFrame) -> DataFrame:
    """(series_id, seq, file_id, field, kinds): the tagged union each file shows for each field."""
    fields = obs.groupBy("series_id", "file_id", "field").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return fields.join(files, ["series_id", "file_id"]).select("series_id", "seq", "file_id", "field", "kinds")


def changes(records: DataFrame) -> DataFrame:
    """(series_id, file_id, change_kind, field_before, field_after, kinds_before, kinds_after) of each change."""
    return _changes(stage(observations(records)), stage(file_order(records)))


def _changes(obs: DataFrame, files: DataFrame) -> DataFrame:
    schemas = stage(file_schemas(obs, files))
    step = ["series_id", "seq", "field"]
    now = schemas.select(*step, F.col("kinds").alias("kinds_after"))
    before = schemas.select("series_id", (F.col("seq") + 1).alias("seq"), "field", F.col("kinds").alias("kinds_before"))
    both = now.join(before, step, "full").join(files, ["series_id", "seq"])  # no file after the last, so none of its fields is removed
    both = stage(both.where("seq > 1"))
    gone = both.where("kinds_after is null").select("series_id", "seq", F.col("field").alias("field_before"), "kinds_before")
    come = both.where("kinds_before is null").select("series_id", "seq", F.col("field").alias("field_after"), "kinds_after", "file_id")
    values = obs.where("canonical is not null and node_id is not null").join(files, ["series_id", "file_id"])
    v = lambda names, side, shift: values.join(
        names.select("series_id", (F.col("seq") - shift).alias("seq"), F.col(f"field_{side}").alias("field")), step, "left_semi",
    ).select("series_id", (F.col("seq") + shift).alias("seq"), "node_id", F.col("field").alias(f"field_{side}"), F.col("canonical").alias(f"v_{side}")).distinct()
    pairs = v(gone, "before", 1).join(v(come, "after", 0), ["series_id", "seq", "node_id"]).groupBy("series_id", "seq", "field_before", "field_after").agg(
        F.count("*").alias("n"), F.count_if(F.col("v_before") == F.col("v_after")).alias("same"))
    pairs = pairs.where("n = same")
    best = lambda a, b: F.row_number().over(Window.partitionBy("series_id", "seq", a).orderBy(F.desc("same"), b))
    renamed = stage(pairs.withColumn("r1", best("field_before", "field_after")).withColumn("r2", best("field_after", "field_before")).where("r1 = 1 and r2 = 1").select("series_id", "seq", "field_before", "field_after"))
    none = F.array().cast("array<string>")
    out = lambda d, kind, a, b: d.select("series_id", "file_id", F.lit(kind).alias("change_kind"), a.alias("field_before"), b.alias("field_after"), F.coalesce("kinds_before", none).alias("kinds_before"), F.coalesce("kinds_after", none).alias("kinds_after"))
    fb, fa, f, no = F.col("field_before"), F.col("field_after"), F.col("field"), F.lit("")
    key = ["series_id", "seq"]
    removed = gone.join(renamed, [*key, "field_before"], "left_anti").join(files, key).withColumn("kinds_after", none)
    added = come.join(renamed, [*key, "field_after"], "left_anti").withColumn("kinds_before", none)
    moved = renamed.join(gone, [*key, "field_before"]).join(come, [*key, "field_after"])
    retyped = both.where("size(kinds_before) > 0 and size(kinds_after) > 0 and kinds_before <> kinds_after")
    return (out(removed, "removed", fb, no).unionByName(out(added, "added", no, fa))
            .unionByName(out(moved, "renamed", fb, fa)).unionByName(out(retyped, "retyped", f, f)))


def unified(records: DataFrame) -> DataFrame:
    """One consistent table of all records: every value under the last name of its field in the series, in the branch
    of its type, with its canonical text. Columns series_id, file_id, row_no, node_id, field, field_as_written,
    kind, canonical, as_string, as_number, as_boolean, as_json. A file delivered twice gives its rows once."""
    obs, files = stage(observations(records)), stage(file_order(records))
    r = _changes(obs, files).where("change_kind = 'renamed'").join(files, ["series_id", "file_id"])
    names = stage(r.select("series_id", "seq", F.col("field_before").alias("field"), F.col("field_after").alias("last")))
    while True:  # follow a chain of renamings to its end, twice as far each round
        later = names.select("series_id", F.col("seq").alias("s2"), F.col("field").alias("last"), F.col("last").alias("last2"))
        hop = names.join(later, ["series_id", "last"], "left").where("s2 is null or s2 > seq")
        step = hop.groupBy("series_id", "seq", "field").agg(F.max("last").alias("old"), F.min_by("last2", "s2").alias("next"))
        full = names.join(step, ["series_id", "seq", "field"], "left").select("series_id", "seq", "field", F.coalesce("next", "last").alias("new"), "last")
        full = stage(full)
        moved = full.where("new <> last").limit(1).count()
        names = full.select("series_id", "seq", "field", F.col("new").alias("last"))
        if not moved:
            break
    v = obs.join(files, ["series_id", "file_id"])
    ren = names.select("series_id", "field", F.col("seq").alias("s"), "last")
    v = v.join(ren, ["series_id", "field"], "left").groupBy("series_id", "file_id", "row_no", "node_id", F.col("field").alias("field_as_written"), "kind", "canonical", "raw").agg(
        F.min_by("last", F.when(F.col("s") > F.col("seq"), F.col("s"))).alias("last"))
    c, k = F.col("canonical"), F.col("kind")
    return v.select("series_id", "file_id", "row_no", "node_id", F.coalesce("last", "field_as_written").alias("field"), "field_as_written", "kind", "canonical",
                    F.when(k == "string", F.get_json_object(F.concat(F.lit('{"v":'), "raw", F.lit("}")), "$.v")).alias("as_string"), F.when(k == "number", F.col("raw").try_cast("double")).alias("as_number"),
                    F.when(k == "boolean", F.col("raw").try_cast("boolean")).alias("as_boolean"), F.when(k.isin("array", "object"), F.col("raw")).alias("as_json"))
