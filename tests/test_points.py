import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import geometry, images, instances, matching, planes, spatial, voxel
from plumbline.operators.components import components

XYZ = "point_idx long, x double, y double, z double"


def pts(spark, rows, more=""):
    return spark.createDataFrame(rows, XYZ + more)


def test_voxels(spark):
    near = lambda c: [(c + d, c - d, c) for d in (0.1, 0.2, -0.1, -0.2)]
    rows = [(i, *p, rgb) for i, (p, rgb) in enumerate([(p, 200) for p in near(15.5)] + [(p, 50) for p in near(37.3)])]
    df = pts(spark, rows, ", r int")
    got = {r["point_idx"]: r["bucket"] for r in voxel.voxel_assign(df, 10).collect()}
    assert [got[i] for i in range(8)] == [0] * 4 + [1] * 4
    c = voxel.voxel_centroid(df, 10, ("r",)).orderBy("first").collect()
    assert [(r["r"], round(r["x"], 6)) for r in c] == [(200, 15.5), (50, 37.3)]
    nan = pts(spark, [(0, 1.0, 1.0, 1.0), (1, math.nan, 1.0, 1.0), (2, 51.0, 51.0, 51.0)])
    assert sorted(r["point_idx"] for r in voxel.voxel_assign(nan, 10).collect()) == [0, 2]
    for bad, leaf in ((df, 0), (df, -0.5), (df.limit(0), 1), (pts(spark, [(0, 0.0, 0.0, 0.0), (1, 150000.0, 0.0, 0.0)]), 0.05)):
        with pytest.raises(ValueError):
            voxel.voxel_assign(bad, leaf)


def test_voxel_normals_keep_empty_buckets(spark):
    a = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "point_idx long, bucket long")
    n = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.1), (1, 0.0, 0.0, 1.0, 0.3), (2, math.nan, 0.0, 0.0, 0.5)], "point_idx long, nx double, ny double, nz double, curvature double")
    r = {x["bucket"]: x for x in voxel.voxel_normals(n, a).collect()}
    assert (r[0]["nz"], round(r[0]["curvature"], 9)) == (1.0, 0.2) and math.isnan(r[1]["nx"]) and r[1]["curvature"] == 0


def cloud(seed, n, spread=1.0):
    rng = random.Random(seed)
    return [(i, *(rng.uniform(0, spread) for _ in range(3))) for i in range(n)]


def test_knn_in_clumps_and_far_away(spark):
    rows = cloud(1, 60, 0.1) + [(100 + i, 50.0 + i, 0.0, 0.0) for i in range(3)] + [(200, 0.0, 0.0, 0.0), (201, 0.0, 0.0, 0.0)]
    df = pts(spark, rows)
    got = {(r["a"], r["rank"]): r["b"] for r in spatial.knn(df, df, 4).collect()}
    for a, *p in rows:
        order = sorted((sum((u - v) ** 2 for u, v in zip(p, q)), b) for b, *q in rows if b != a)[:4]
        assert [got[a, k] for k in range(1, 5)] == [b for _, b in order]
    assert spatial.knn(df, df.limit(2), 4).where("a = 100").count() == 2
    assert spatial.knn(df, df.limit(0), 4).count() == 0 and spatial.knn(df.limit(0), df, 4).count() == 0


def test_votes_and_outliers(spark):
    df = pts(spark, [(0, 0.0, 0.0, 0.0, 5), (1, 0.1, 0.0, 0.0, 3), (2, 0.0, 0.1, 0.0, 5), (3, 0.1, 0.1, 0.0, 3), (9, 9.0, 9.0, 9.0, 7)], ", label long")
    got = {r["point_idx"]: r["label"] for r in spatial.majority_vote(df, df.where("label <> 7"), 0.5).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 9: -1}
    assert {r["point_idx"] for r in spatial.radius_outliers(df, 0.5, 4).where("not keep").collect()} == {9}
    assert {r["point_idx"] for r in spatial.statistical_outliers(df, 2).where("not keep").collect()} == {9}


def blob(rng, c, n, label, at):
    return [(at + i, *(rng.gauss(v, 0.1) for v in c), label) for i in range(n)]


def test_instances(spark):
    rng = random.Random(42)
    rows = blob(rng, (0, 0, 0), 100, 1, 0) + blob(rng, (5, 0, 0), 100, 1, 100) + blob(rng, (0, 0, 0.0), 100, 2, 200) + blob(rng, (0, 5, 0), 20, 1, 300) + blob(rng, (9, 9, 9), 60, 0, 400)
    df = pts(spark, rows, ", label long")
    sizes = lambda d: sorted((r["label"], r["instance"], r["count"]) for r in d.where("instance > 0").groupBy("label", "instance").count().collect())
    assert sizes(instances.instances(df, 0.5, 50)) == [(1, 1, 100), (1, 2, 100), (2, 3, 100)]
    assert sizes(instances.instances(df, 0.5, 10, labels=[1])) == [(1, 1, 100), (1, 2, 100), (1, 3, 20)]
    assert instances.instances(df.where("label = 0"), 0.5).where("instance > 0").count() == 0
    with pytest.raises(ValueError):
        instances.instances(df, -0.5)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


CUBE_V = [(i, float(i & 1) * 4, float(i >> 1 & 1) * 3, float(i >> 2 & 1) * 2.5) for i in range(8)]
CUBE_F = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def mesh(spark, shift=0):
    return spark.createDataFrame(CUBE_V, "v long, x double, y double, z double"), spark.createDataFrame([(i, list(f)) for i, f in enumerate(CUBE_F)], "face long, verts array<long>")


def test_mesh_operators(spark):
    v, f = mesh(spark)
    assert round(instances.face_normals(v, f).agg(F.sum("area")).first()[0], 6) == 2 * (12 + 10 + 7.5)
    nv, nf = instances.unweld(v, f)
    assert nv.count() == 24 and nf.count() == 12  # each corner of a box belongs to three sides
    assert nv.agg(F.max("v")).first()[0] == 23
    two = f.unionByName(f.select((F.col("face") + 100).alias("face"), F.transform("verts", lambda x: x + 50).alias("verts")))
    assert {(r["part"], r["count"]) for r in instances.mesh_parts(two).groupBy("part").count().collect()} == {(0, 12), (50, 12)}
    pv, pf = instances.mesh_split(v.unionByName(v.withColumn("v", F.col("v") + 50)), two)
    assert pv.groupBy("part").agg(F.max("v").alias("m")).where("m = 7").count() == 2 and pf.count() == 24


def test_polygons(spark):
    rings = {"square": [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], "triangle": [(0, 0, 0), (2, 0, 0), (0, 2, 0)], "upright": [(0, 0, 0), (0, 3, 0), (0, 3, 2), (0, 0, 2)], "line": [(0, 0, 0), (1, 0, 0)]}
    c = spark.createDataFrame([(n, k, *map(float, p)) for n, r in rings.items() for k, p in enumerate(r)], "polygon string, k int, x double, y double, z double")
    m = {r["polygon"]: r for r in geometry.polygon_measures(c).collect()}
    assert {n: (round(r["area"], 9), r["valid"]) for n, r in m.items()} == {"square": (1, True), "triangle": (2, True), "upright": (6, True), "line": (0, False)}
    ring = F.expr("array(named_struct('u', 0D, 'v', 0D), named_struct('u', 4D, 'v', 0D), named_struct('u', 4D, 'v', 2D), named_struct('u', 0D, 'v', 2D))")
    p = spark.createDataFrame([(1.0, 1.0, 0.5), (5.0, 1.0, 0.0), (4.0, 5.0, 4.0)], "u double, v double, w double")
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    assert [tuple(r) for r in p.select(geometry.inside_polygon(u, v, ring), geometry.wall_distance(u, v, w, ring)).collect()] == [(True, 0.5), (False, 1.0), (False, 5.0)]


def test_motions():
    rng = np.random.default_rng(0)
    for scale in (1e-8, 1e-3, 1.0, 3.0):
        x = rng.normal(size=6)
        x[3:] *= min(scale, 3.1) / np.linalg.norm(x[3:])
        assert np.allclose(geometry.se3_log(geometry.se3_exp(x)), x, atol=1e-7)


def test_planes_of_a_building():
    n, pts_ = np.array([1.0, 0, 0]), np.array([[0.0, y, z] for y in range(5) for z in range(5)])
    make = lambda x, s: {"n": n * s, "d": -x * s, "c": np.array([x, 2.0, 2.0]), "points": pts_ + [x, 0, 0]}
    assert len(geometry.merge_planes([make(0, 1), make(0.1, 1), make(3, 1)])) == 2
    pairs = geometry.pair_planes([make(0, 1), make(-0.3, -1), make(5, 1)])
    assert [("synthetic" in b) for _, b in pairs] == [False, True]
    r = geometry.regularise(np.array([[0.05, 0.02, 1.0], [1.0, 0.02, 0.0], [0.03, 1.0, 0.0]]))
    assert np.allclose(r[0], [0, 0, 1]) and abs(r[1] @ r[2]) < 1e-9


def test_region_growing_and_components_agree_on_two_walls(spark):
    rows = [("c", i * 20 + j, i * 0.1, j * 0.1, 0.0, 0.0, 0.0, 1.0, 0.01) for i in range(20) for j in range(20)] + [("c", 400 + i * 20 + j, 5.0, i * 0.1, 1 + j * 0.1, 1.0, 0.0, 0.0, 0.02) for i in range(20) for j in range(20)]
    df = spark.createDataFrame(rows, "cloud string, point_idx long, x double, y double, z double, nx double, ny double, nz double, curvature double")
    for got in (planes.grow_regions(df, least=100, radius=0.25), planes.coplanar_components(df, least=100, radius=0.25)):
        by = {r["point_idx"]: r["plane"] for r in got.collect()}
        assert len({by[i] for i in range(400)}) == 1 == len({by[i] for i in range(400, 800)}) and by[0] != by[400] and 0 not in by.values()
    fit = planes.refit_planes(df.join(planes.coplanar_components(df, least=100, radius=0.25), "point_idx")).collect()
    assert sorted(round(abs(r["d"]), 6) for r in fit) == [0.0, 5.0]


def test_nearest_in_time(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    f = [(i, at(s)) for i, s in enumerate([0, 10, 10, 50_000, 100_000])] + [(99, None)]
    q = [(0, at(-9)), (1, at(4)), (2, at(5)), (3, at(10)), (4, at(29_000)), (5, at(900_000)), (6, None)]
    got = {r["query_id"]: (r["node_id"], r["dt_us"] // 10**6) for r in matching.nearest_in_time(spark.createDataFrame(q, "query_id long, ts timestamp_ntz"), spark.createDataFrame(f, "node_id long, ts timestamp_ntz")).collect()}
    assert got == {0: (0, 9), 1: (0, 4), 2: (0, 5), 3: (1, 0), 4: (3, 21000), 5: (4, 800000)}


def test_depth_filters(spark):
    d = np.full((12, 12), 1000, "<u2")
    d[:, 6:] = 3000
    d[3, 2] = 1500
    conf = np.full(144, 2, np.uint8)
    df = spark.createDataFrame([(1, 12, 12, d.tobytes(), conf.tobytes()), (2, 12, 12, None, None)], "node_id long, width int, height int, depth binary, conf binary")
    r = {x["node_id"]: x for x in images.filter_depth(df, ray=None).collect()}
    z = np.frombuffer(r[1]["depth"], "<u2").reshape(12, 12)
    assert (z[:, 5:7] == 0).all() and (z[6:, :5] == 1000).all() and (z[:, 7:] == 3000).all() and r[2]["depth"] is None
    assert (np.frombuffer(r[1]["conf"], np.uint8).reshape(12, 12)[:, 5] == 0).all()
    assert images.ray_outliers(images.decode_depth(d.tobytes(), 12, 12))[3, 2]
    meta = df.where("node_id = 1").withColumns({c: F.lit(v) for c, v in (("fx", 10.0), ("fy", 10.0), ("cx", 6.0), ("cy", 6.0))}).withColumn("pose", F.array(*(F.lit(float(x)) for x in (1, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)))).withColumn("local", F.array(*(F.lit(float(x)) for x in np.eye(4).ravel())))
    p = images.world_points(meta, step=4, confidence=2).orderBy("u", "v").collect()
    assert len(p) == 9 and (p[0]["x"], p[0]["y"], p[0]["z"]) == (5 - 0.6, -0.6, 1.0)
    assert images.surfels(meta, step=1).count() == 144 and images.surfels(meta, step=6).count() == 0
