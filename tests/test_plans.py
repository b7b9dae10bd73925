import pytest
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows
from plumbline.plans import labels, paths


def cloud(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "point_idx long, label long")


@pytest.mark.parametrize("text,n", [
    ("planes == 5", 10), ("planes in [1, 2, 5]", 30), ("planes != 1", 90), ("planes > 5", 50), ("planes >= 5", 60), ("planes < 5", 40), ("planes <= 5", 50),
    ("planes >= 3 && planes <= 7", 50), ("planes == 1 || planes == 10", 20), ("(planes == 1 || planes == 2) && planes != 3", 20), ("planes in []", 0), ("planes == 1 || planes == 2 && planes == 3", 10), ("((planes == -1))", 0),
])
def test_filters(spark, text, n):
    got = [r[0] for r in labels.select_points(text, {"planes": cloud(spark, [i // 10 + 1 for i in range(100)])}).orderBy("point_idx").collect()]
    assert len(got) == n


def test_filters_over_two_clouds(spark):
    c = {"planes": cloud(spark, [1] * 50 + [2] * 50), "rooms": cloud(spark, [10] * 50 + [11] * 50), "short": cloud(spark, [1] * 50), "neg": cloud(spark, range(-50, 50))}
    count = lambda t: labels.select_points(t, c).count()
    assert [count(t) for t in ("planes == 1 || rooms == 10", "planes == 1 || rooms == 11", "planes == 1 && rooms == 11", "planes == 1 && rooms == 10", "neg < 0", "neg == 999")] == [50, 100, 0, 50, 50, 0]
    with pytest.raises(labels.FilterError):
        count("planes == 1 && short == 1")
    with pytest.raises(labels.FilterError, match="planes"):
        count("plane == 1")


@pytest.mark.parametrize("text", ["", "  ", "planes in 1, 2]", "invalid ==", "planes = 1", "planes == 1 planes", "(planes == 1", "planes in [1,]", "planes in [,1]", "== 1", "in == 1", "planes == x", "a == 1 &&", "!a"])
def test_no_filters(text):
    with pytest.raises(labels.FilterError):
        labels.compile_filter(text)


def test_hints():
    assert labels.looks_complete("a in 1") and labels.looks_complete("(a == 1") and labels.looks_complete("a in [1]") is None
    assert labels.suggestions("plane", ["planes", "rooms"]) == ["planes"]


def test_missing_label_counts_as_minus_one(spark):
    f = labels.compile_filter("x == -1")
    assert spark.createDataFrame([(None,), (1,)], "x long").where(f.column()).count() == 1


def test_paths():
    p = paths.parse_path
    assert p("clouds") == paths.ResourcePath("clouds") and p("clouds/a//b") == paths.ResourcePath("clouds", None, "a", ("b",)) and p("meshes[3].vertex_count") == paths.ResourcePath("meshes", 3, None, ("vertex_count",))
    assert p("clouds.s*.type").wild
    for bad in ("", ".", "nothing.x", "clouds[x]", "clouds.a[0]", "clouds[-1]", "clouds[1"):
        with pytest.raises(paths.PathError):
            p(bad)


def test_resolving(spark):
    import datetime as dt

    c = spark.createDataFrame([("b", 1, b"x"), ("a.c", 2, b"y"), ("axc", 3, None)], "name string, point_count int, data binary").withColumn("id", F.monotonically_increasing_id())
    pr = spark.createDataFrame([("p2", "two", dt.datetime(2024, 1, 1)), ("p1", "one", dt.datetime(2024, 1, 1))], "id string, name string, at timestamp_ntz")
    t = {"clouds": c, "projects": pr}
    rows = lambda q: sorted(tuple(r) for r in paths.resolve(t, q).collect())
    assert rows("clouds.a*.point_count") == [("a.c", "2"), ("axc", "3")] and rows("clouds[0].point_count") == [("a.c", "2")] and rows("projects.p2.name") == [("p2", "two")] and rows("projects.name") == [("p1", "one")]
    assert "data" not in rows("clouds.b.metadata")[0][1] and rows("clouds.z*") == []
    for bad in ("clouds.nope", "clouds[9]", "clouds.b.nope", "meshes"):
        with pytest.raises(paths.PathError):
            rows(bad)
    with pytest.raises(paths.PathError):
        paths.check_delete(t, "clouds.a*")
    with pytest.raises(paths.PathError):
        paths.check_delete(t, "clouds.a*", force=True, limit=1)
    assert paths.check_delete(t, "clouds.a*", force=True) == ["a.c", "axc"]


def test_numbering(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("v"))
    rows = number_rows(df, F.desc("v")).collect()
    assert sorted((r["rn"], r["v"]) for r in rows) == [(i + 1, 999 - i) for i in range(1000)]
    assert number_rows(df.limit(0), "v").count() == 0
