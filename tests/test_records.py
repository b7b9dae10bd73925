"""Drift, nesting, orphans and attribute-value rows on small inputs with every kind of dirt."""

import datetime as dt
import json

import pytest

from plumbline.functions import jsontext
from plumbline.operators import drift, eav, nested, orphans

T = dt.datetime


# ---- attribute-value rows

DEFS = [("d1", "g1", "size_mm", "Integer ", "x"), ("d2", "g2", "weight", "double", "x"), ("d3", "g3", "ok", "boolean", "x"), ("d4", "g4", "state", "TRISTATE", "x"), ("d5", None, "tags", "string_array", "x"), ("d6", "g6", "note", "string", "x"), ("d7", "g7", "size_mm", "integer", "x")]
DEF_SCHEMA, VAL_SCHEMA = "id string, leksikon_guid string, field_name string, type string, value string", "id string, passport_id string, property_id string, leksikon_guid string, sort_order int, value binary, recorded_at timestamp_ntz, field_name string"


def values(*cells):
    return [(f"v{i}", p, pid, guid, i, None if v is None else v.encode(), T(2024, 1, 1) + dt.timedelta(days=i), "clash") for i, (p, pid, guid, v) in enumerate(cells)]


def test_fitting_values(spark):
    good = {"d1": ["7", "-12", "+0", " 3\t"], "d2": ["1", "1.5", ".5", "5.", "1,5", "-1e3", "1.5E-7"], "d3": ["true", "FALSE", "0", "1"], "d4": ["Yes", "no", "UNKNOWN"], "d5": ["[]", '["a", 1]', ' [{"a": [1]}] '], "d6": ["anything", "[1"]}
    bad = {"d1": ["1.0", "x", "1 2", "--1", "+"], "d2": ["1.2.3", "1,2,3", "e3", ".", "1.5x", "NaN", "1e"], "d3": ["ja", "2", "yes"], "d4": ["maybe", "true"], "d5": ["{}", "[1", "[1],[2]", "[1]]", '"[]"', '[1],"b":[2]', "[1] x", "[,]"], "d6": []}
    rows = values(*((f"{pid}-{k}-{i}", pid, None, v) for k, side in (("good", good), ("bad", bad)) for pid, vs in side.items() for i, v in enumerate(vs)))
    got = {r["passport_id"] for r in eav.misfits(spark.createDataFrame(rows, VAL_SCHEMA), spark.createDataFrame(DEFS, DEF_SCHEMA)).collect()}
    assert got == {f"{pid}-bad-{i}" for pid, vs in bad.items() for i in range(len(vs))}


def test_wide_rows(spark):
    rows = values(("p", "d1", "g1", "1"), ("p", "d1", None, "x"), ("p", None, "g2", "1,5"), ("p", "d2", "g1", "2.5"), ("p", None, "g7", "44"), ("p", "nope", "g3", "true"), ("p", None, None, "5"), ("p", "d3", None, "  "), ("p", "d4", None, None), (None, "d1", None, "5"), ("q", "d5", None, '["a"]'), ("q", "d3", None, "1"))
    r = {x["passport_id"]: x for x in eav.wide(spark.createDataFrame(rows * 2, VAL_SCHEMA), spark.createDataFrame(DEFS, DEF_SCHEMA)).collect()}
    assert set(r) == {"p", "q"}
    assert (r["p"]["size_mm"], r["p"]["weight"], r["p"]["ok"], r["p"]["cast_failures"]) == (44, 2.5, None, {"size_mm": "x"})
    assert (r["q"]["tags"], r["q"]["ok"], r["q"]["cast_failures"]) == (["a"], True, {})


def test_eav_empty(spark):
    v, d = spark.createDataFrame([], VAL_SCHEMA), spark.createDataFrame([], DEF_SCHEMA)
    assert eav.misfits(v, d).count() == 0
    assert eav.wide(v, spark.createDataFrame(DEFS, DEF_SCHEMA)).count() == 0


# ---- nesting

BODIES = [
    {"sections": [{"properties": [{"guid": "a"}, None, {"guid": "b", "parts": [{"properties": {"guid": "c"}}]}, "text", [{"guid": "no"}]]}, {"properties": {"guid": None, "value": '{"properties": [{"guid": "text"}]}'}}]},
    [{"properties": [{"guid": 7}]}, 5, {"x": {"properties": [{}]}}],
]


def test_properties_at_any_depth(spark):
    rows = [(i, json.dumps(b), "clash") for i, b in enumerate(BODIES)] * 2 + [(8, None, ""), (9, "", ""), (10, '{"properties": [{"guid": "x"}', ""), (11, "[1] 2", ""), (12, "NaN", ""), (13, '{"properties": [{"guid": "\\ud800"}]}', "")]
    df = spark.createDataFrame(rows, "record_id long, body string, level string")
    got = {tuple(r) for r in nested.properties(df).collect()}
    assert got == {(0, "sections[0].properties[0]", "a"), (0, "sections[0].properties[2]", "b"), (0, "sections[0].properties[2].parts[0].properties[0]", "c"), (0, "sections[1].properties[0]", ""),
                   (1, "[0].properties[0]", "7"), (1, "[2].x.properties[0]", ""), (13, "properties[0]", "�")}
    assert {tuple(r) for r in nested.rejected(df).collect()} == {(8, "null"), (9, "empty"), (10, "invalid"), (11, "invalid"), (12, "invalid")}
    assert nested.properties(df.limit(0)).count() == 0


def test_child_tables_keep_their_links(spark):
    df = spark.createDataFrame([(1, json.dumps(BODIES[0]))], "record_id long, body string")
    n = nested.nodes(df).cache()
    keys = {r["node_path"] for r in n.collect()}
    assert all(r["parent_path"] in keys for r in n.collect() if r["parent_path"] is not None)
    schema = nested.merged_schema(n)
    t = {r["node_path"]: r for r in nested.child_table(n, schema, "sections[].properties[]").collect()}
    assert t["sections[0].properties[2]"]["guid"] == "b" and t["sections[0].properties[2]"]["ordinal"] == 2
    assert {r["field"]: r["kinds"] for r in schema.collect()}["value"] == ["string"]


def test_levels_and_walk_agree(spark, monkeypatch):
    """Random bodies exploded level by level and walked give the same nodes; a limit on levels only changes who does it."""
    import random

    rng = random.Random(4)

    def value(depth):
        k = rng.choice([0, 1, 2, 3, 4, 5, 6, 6, 7, 7, 7, 7]) if depth else rng.randrange(5)
        if k < 5:
            return [None, 3, 2.5, "æ \" x", True][k]
        if k == 5:
            return [value(0) for _ in range(rng.randrange(3))]
        if k == 6:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["guid", "properties", "parts", "a b", "x.y", "value"]): value(depth - 1) for _ in range(rng.randrange(1, 5))}

    rows = [(i, json.dumps(value(6))) for i in range(200)] + [(500, '{"a":1,"a":{"guid":2}}'), (501, '{"a":[1}'), (502, ' {"properties": {"guid": 5}} '), (503, "1],[2"), (504, '1,"b":0}')]
    df = spark.createDataFrame(rows, "record_id long, body string")
    take = lambda: sorted((tuple(r)[:-1] + (tuple(sorted(r["attributes"].items())),) for r in nested.nodes(df).collect()), key=str)
    want = take()
    assert len(want) > 200 and {r[0] for r in want} >= {500, 502} and not {r[0] for r in want} & {501, 503, 504}
    for steps in (1, 3):
        monkeypatch.setattr(nested, "STEPS", steps)
        assert take() == want


def test_very_deep_nesting(spark):
    deep = '{"properties":[' * 800 + "{}" + "]}" * 800
    got = nested.properties(spark.createDataFrame([(1, deep)], "record_id long, body string"))
    assert got.count() == 800


@pytest.mark.parametrize("text", ['{"a": [1, {"b": null}], "c": "x\\"y", "d": -1.5e3}', "[]", "{}", '"x"', " [1 , 2 ] ", "[[],{}]", '{"a":{"b":[]}}'])
def test_deep_parser_agrees(text):
    assert jsontext._parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "[1", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "{1:2}", "tru", "[1]]", '{"a":1 "b":2}', "-", "01x"])
def test_deep_parser_refuses(text):
    with pytest.raises(ValueError):
        jsontext._parse_deep(text)


# ---- drift

def export(series, file, day, *records, twice=False):
    rows = [(series, file, i, T(2024, 1, day), T(2024, 2, day), r if isinstance(r, str) else json.dumps(r), "clash") for i, r in enumerate(records)]
    return rows * 2 if twice else rows


DRIFT = "series_id string, file_id string, row_no int, exported_at timestamp_ntz, received_at timestamp_ntz, payload string, field string"


def test_changes(spark):
    rows = (
        export("s", "f1", 1, {"node_id": 1, "a": 5, "b": "x", "flag": True}, {"node_id": 2, "a": 6, "b": "y", "gone": None}, twice=True)
        + export("s", "f2", 2, {"node_id": 1, "a2": 5.0, "b": ["x"], "flag": True}, {"node_id": 3, "a2": 9, "b": ["z"], "new": None})
        + export("s", "f3", 3, {"node_id": 1, "a2": 5, "b": None, "flag2": False}, {"node_id": 2, "a2": "6", "b": None})
        + export("s", "f4", 4, "[1]", "{broken")
        + export("t", "g1", 1, {"node_id": 1, "z": 1})
    )
    got = {tuple(r)[1:5] for r in drift.changes(spark.createDataFrame(rows, DRIFT)).collect()}
    assert got == {
        ("f2", "renamed", "a", "a2"), ("f2", "retyped", "b", "b"), ("f2", "removed", "gone", ""), ("f2", "added", "", "new"),
        ("f3", "retyped", "a2", "a2"), ("f3", "removed", "new", ""), ("f3", "removed", "flag", ""), ("f3", "added", "", "flag2"),
        ("f4", "removed", "a2", ""), ("f4", "removed", "b", ""), ("f4", "removed", "flag2", ""), ("f4", "removed", "node_id", ""),
    }


def test_alternatives_at_nested_paths(spark):
    rows = export("s", "f1", 1, {"node_id": 1, "h": 5, "t": ["x"]}, twice=True) + export("s", "f2", 2, {"node_id": 1, "h": {"value": 5, "u": None}, "t": [1, "x"]}) + export("s", "f3", 3, {"node_id": 1, "h": {"value": "5"}})
    got = {tuple(r)[1:] for r in drift.path_changes(spark.createDataFrame(rows, DRIFT)).collect()}
    assert got == {("f2", "h", "object", "appears"), ("f2", "h", "number", "goes"), ("f2", "h.value", "number", "appears"), ("f2", "t[]", "number", "appears"),
                   ("f3", "h.value", "string", "appears"), ("f3", "h.value", "number", "goes"), ("f3", "t", "array", "goes"), ("f3", "t[]", "string", "goes"), ("f3", "t[]", "number", "goes")}
    assert drift.path_changes(spark.createDataFrame([], DRIFT)).count() == 0


def test_changes_beside_their_entries(spark):
    rows = export("s", "f1", 1, {"node_id": 1, "a": 5}) + export("s", "f2", 5, {"node_id": 1, "b": 5, "c": 1}) + export("s", "f3", 9, {"node_id": 1, "b": "5", "c": 1})
    v = [("s", 1, T(2024, 1, 1), "first"), ("s", 2, T(2024, 1, 5), "Rename a to B"), ("s", 2, T(2024, 1, 5), "Rename a to B"), ("s", 3, T(2024, 1, 6), None), ("s", 4, T(2024, 1, 20), "widen b"), (None, 1, T(2024, 1, 1), "a")]
    df, vs = spark.createDataFrame(rows, DRIFT), spark.createDataFrame(v, "series_id string, version int, applied_at timestamp_ntz, description string")
    got = {tuple(r)[1:] for r in drift.described(df, vs).collect()}
    assert got == {("f2", "renamed", "a", "b", "2", "Rename a to B", "described"), ("f2", "added", "", "c", None, None, "undescribed"), ("f3", "retyped", "b", "b", None, None, "undescribed"),
                   (None, None, None, None, "1", "first", "entry_only"), (None, None, None, None, "3", None, "entry_only"), (None, None, None, None, "4", "widen b", "entry_only")}


def test_one_table_of_all_files(spark):
    rows = export("s", "f1", 1, {"node_id": 1, "a": 5}) + export("s", "f2", 2, {"node_id": 1, "b": 5}) + export("s", "f3", 3, {"node_id": 1, "c": {"value": 5, "unit": "m"}})
    got = {(r["file_id"], r["field"], r["field_as_written"], r["canonical"], r["as_number"], r["as_json"]) for r in drift.unified(spark.createDataFrame(rows * 2, DRIFT)).collect() if r["field"] != "node_id"}
    assert got == {("f1", "c", "a", "5.0", 5.0, None), ("f2", "c", "b", "5.0", 5.0, None), ("f3", "c", "c", "5.0", None, '{"unit":"m","value":5}')}
    empty = spark.createDataFrame([], DRIFT)
    assert drift.changes(empty).count() == 0 and drift.unified(empty).count() == 0


# ---- orphans

def test_direct_and_inherited_orphans(spark):
    clouds = [(1, T(2024, 1, 1), None, "x"), (2, T(2024, 1, 1), T(2024, 2, 1), "x"), (2, T(2024, 1, 1), T(2024, 2, 1), "x"), (3, T(2024, 5, 1), None, "x")]
    data = [(1, 0, T(2024, 1, 2), "c"), (2, 0, T(2024, 1, 15), "c"), (2, 1, T(2024, 3, 15), "c"), (2, 1, T(2024, 3, 15), "c"), (3, 0, T(2024, 4, 30), "c"), (9, 0, None, "c"), (None, 0, T(2024, 1, 1), "c")]
    comps = [(1, 99, T(2024, 1, 1)), (2, 1, T(2024, 1, 2)), (3, 2, T(2024, 1, 3)), (4, -1, T(2024, 1, 1)), (5, 6, T(2024, 1, 1)), (6, None, T(2024, 1, 2)), (7, 8, T(2024, 1, 2)), (8, 7, T(2024, 1, 2)), (None, 4, T(2024, 1, 2))]
    tables = {
        "point_clouds": spark.createDataFrame(clouds, "id long, created_at timestamp_ntz, deleted_at timestamp_ntz, cloud_id string"),
        "point_cloud_data": spark.createDataFrame(data, "cloud_id long, chunk_index int, recorded_at timestamp_ntz, id string"),
        "label_definitions": spark.createDataFrame([], "cloud_id long, label_id int, recorded_at timestamp_ntz"),
        "building_components": spark.createDataFrame(comps, "id long, parent_id int, created_at timestamp_ntz"),
    }
    got = {tuple(r) for r in orphans.cascade(tables).collect()}
    assert got == {
        ("point_cloud_data", 2, 1, "2024-03", "deleted", "direct", 0), ("point_cloud_data", 3, 0, "2024-04", "late", "direct", 0), ("point_cloud_data", 9, 0, None, "missing", "direct", 0),
        ("building_components", 99, 1, "2024-01", "missing", "direct", 0), ("building_components", 6, 5, "2024-01", "late", "direct", 0),
        ("building_components", 1, 2, "2024-01", "missing", "inherited", 1), ("building_components", 2, 3, "2024-01", "missing", "inherited", 2),
    }
    assert orphans.cascade({k: v.limit(0) for k, v in tables.items()}).count() == 0


def test_cascade_over_three_tables(spark):
    """site <- house (two parents each) <- room <- room, and keys; a loop of rooms that is sound and one that hangs on an orphan."""
    at, R = T(2024, 1, 1), orphans.Reference
    refs = (R("house", "site", "id", "made", "site", created_at="made", child_key="id"), R("house", "owner", "id", "made", "owner", created_at="made", child_key="id"),
            R("room", "house", "id", "made", "house", created_at="made", child_key="id"), R("room", "up", "id", "made", "room", created_at="made", child_key="id"),
            R("keys", "room", "no", "made", "room", created_at="made"))
    tables = {
        "site": spark.createDataFrame([(1, at)], "id long, made timestamp_ntz"), "owner": spark.createDataFrame([(1, at)], "id long, made timestamp_ntz"),
        "house": spark.createDataFrame([(10, 1, 1, at), (11, 1, 9, at), (12, None, None, at)], "id long, site long, owner long, made timestamp_ntz"),
        # room 3 stands twice, under a sound and under an orphaned room; 6 and 7 are a loop; 8 and 9 are one below room 4
        "room": spark.createDataFrame([(1, 10, None, at), (2, 11, None, at), (3, None, 1, at), (3, None, 2, at), (4, None, 3, at), (6, None, 7, at), (7, None, 6, at), (8, None, 9, at), (9, None, 8, at), (9, None, 4, at)], "id long, house long, up long, made timestamp_ntz"),
        "keys": spark.createDataFrame([(1, 100, at), (4, 101, at), (6, 102, at), (8, 103, at), (77, 104, at)], "room long, no long, made timestamp_ntz"),
    }
    got = {tuple(r)[:3] + (r["orphan_kind"], r["origin"], r["hops"]) for r in orphans.cascade(tables, refs).collect()}
    assert got == {
        ("house", 9, 11, "missing", "direct", 0), ("keys", 77, 104, "missing", "direct", 0), ("room", 11, 2, "missing", "inherited", 1),
        ("room", 2, 3, "missing", "inherited", 2), ("room", 3, 4, "missing", "inherited", 3), ("keys", 4, 101, "missing", "inherited", 4),
        ("room", 4, 9, "missing", "inherited", 4), ("room", 9, 8, "missing", "inherited", 5), ("keys", 8, 103, "missing", "inherited", 6), ("room", 8, 9, "missing", "inherited", 6),
    }


def test_cascade_down_a_long_chain(spark):
    at = T(2024, 1, 1)
    r = orphans.Reference("c", "up", "id", "made", "c", created_at="made", child_key="id")
    got = orphans.cascade({"c": spark.createDataFrame([(i, i - 1, at) for i in range(1, 301)], "id long, up long, made timestamp_ntz")}, (r,)).collect()
    assert sorted((x["child_no"], x["hops"]) for x in got) == [(i, i - 1) for i in range(1, 301)]
