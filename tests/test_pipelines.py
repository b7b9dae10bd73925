"""Whole stages on a made-up room, the commands around them, and what they refuse."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.functions import codes
from plumbline.operators import cells, geometry, images, store, vision
from plumbline.plans import paths, pipelines
from plumbline.session import stage

XYZ = "point_idx long, x double, y double, z double, r short, g short, b short"


def box(spark, size=(4.0, 3.0, 2.5), step=0.25):
    """Points on the inside of a box, with inward normals and the number of their side."""
    out = []
    for axis in range(3):
        u, v = [k for k in range(3) if k != axis]
        for end in (0.0, size[axis]):
            for a in np.arange(step / 2, size[u], step):
                for b in np.arange(step / 2, size[v], step):
                    p, n = np.zeros(3), np.zeros(3)
                    p[axis], p[u], p[v] = end, a, b
                    n[axis] = 1.0 if end == 0 else -1.0
                    out.append((len(out), *map(float, p), *map(float, n), axis * 2 + (end > 0) + 1))
    return spark.createDataFrame(out, "point_idx long, x double, y double, z double, nx double, ny double, nz double, side long")


@pytest.fixture
def project(spark, tmp_path):
    p = pipelines.Project(spark, str(tmp_path / "p"))
    b = box(spark)
    p.save_cloud("cloud", b.select("point_idx", "x", "y", "z", *(F.lit(7).cast("short").alias(c) for c in "rgb")))
    p.save_cloud("normals", b.select("point_idx", "nx", "ny", "nz", F.lit(0.0).alias("curvature")))
    p.save_cloud("labels", b.select("point_idx", (F.col("side") % 2).alias("label")))
    return p


def run(p, *a, stdin=None):
    out = io.StringIO()
    return cli.main([p.folder, *a], out, stdin), out.getvalue()


def test_from_cloud_to_mesh(spark, project):
    p = project
    with pytest.raises(pipelines.NotReady, match="create planes"):
        pipelines.preflight(p, "rooms")
    assert run(p, "create", "mesh")[0] == 1
    assert run(p, "create", "planes", "--inliers", "50") == (0, "6\n")
    assert run(p, "create", "rooms")[0] == 0
    rooms = {r["label"] for r in p.cloud("rooms").select("label").distinct().collect()}
    assert rooms == {0}
    code, text = run(p, "create", "mesh", "--offset", "0.3")
    assert code == 0 and json.loads(text)["planes"] == 6
    v, f = (t.toPandas() for t in p.mesh())
    at = v.set_index("v")[["x", "y", "z"]]
    tri = np.array([[at.loc[i] for i in t] for t in f.verts])
    volume = np.einsum("ij,ij->i", tri[:, 0], np.cross(tri[:, 1], tri[:, 2])).sum() / 6
    assert abs(volume - 30) < 0.5
    assert p.table("meshes").first()["face_count"] == len(f)
    log = {r["stage"]: r["status"] for r in p.table("pipeline_log").collect()}
    assert log["create mesh"] == "success"
    assert [r["status"] for r in p.table("pipeline_log").where("stage = 'create mesh'").orderBy("id").collect()] == ["failed", "success"]


def test_filters_downsampling_and_instances(spark, project):
    p = project
    with pytest.warns(UserWarning, match="no point"):
        assert pipelines.selected(p, "labels == 9").count() == 0
    assert pipelines.selected(p, "labels == 1").count() == p.cloud("cloud").count() // 2
    with pytest.raises(ValueError):
        pipelines.selected(p, "nothing == 1")
    assert run(p, "create", "instances", "--tolerance", "0.4", "--smallest", "10")[0] == 0
    assert p.table("label_names").where("cloud_name = 'instances'").count() == p.cloud("instances").where("label > 0").select("label").distinct().count() > 0
    n = p.cloud("cloud").count()
    assert run(p, "edit", "downsample", "0.5", "--with", "normals", "--with", "labels:few")[0] == 0
    assert p.cloud("cloud").count() == p.cloud("normals").count() == p.cloud("few").count() < n == p.cloud("labels").count()
    assert run(p, "edit", "downsample", "0.5", "--with", "labels")[0] == 1


def frames(spark, n=3):
    """A camera moved along x before a wall two metres away and a floor edge."""
    out = []
    for k in range(n):
        d = np.full((24, 32), 2000, "<u2")
        d[16:, :] = 1500
        pose = np.eye(4)
        pose[0, 3] = 0.1 * k
        out.append((k + 1, 32, 24, bytearray(d.tobytes()), bytearray(np.full(24 * 32, 3, np.uint8).tobytes()), pose.ravel().tolist(), np.eye(4).ravel().tolist(), 20.0, 20.0, 16.0, 12.0, float(k) if k else -1.0))
    return spark.createDataFrame(out, "node_id long, width int, height int, depth binary, conf binary, pose array<double>, local array<double>, fx double, fy double, cx double, cy double, timestamp double")


def test_clouds_of_frames_and_refined_poses(spark, tmp_path):
    p = pipelines.Project(spark, str(tmp_path / "p"))
    p.save("sensor_frames", frames(spark))
    p.save("label_pixels", spark.range(24 * 32).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("node_id"), (F.col("id") % 32).cast("int").alias("u"), F.floor(F.col("id") / 32).cast("int").alias("v"), F.lit(5).alias("label")))
    got = pipelines.create_clouds(p, grid=0.1, step=1, neighbours=8, factor=3.0, radius=0.4, enough=3)
    assert got["frames"] == 3 and got["points"] > 50
    c = p.cloud("cloud").toPandas().sort_values("point_idx")
    assert list(c.point_idx) == list(range(len(c))) and c.z.between(1.4, 2.1).all()
    assert p.cloud("normals").count() == p.cloud("labels").count() == len(c)
    assert {r["label"] for r in p.cloud("labels").collect()} == {5}
    before = {r["node_id"]: r["pose"] for r in p.table("sensor_frames").collect()}
    pipelines.register(p, step=2, rounds=1, dry_run=True, radius=0.5, distance=0.3)
    assert {r["node_id"]: r["pose"] for r in p.table("sensor_frames").collect()} == before
    local = {1: np.eye(4), 2: np.diag([1.0, -1, -1, 1])}
    world = {1: np.eye(4), 2: geometry.se3_exp(np.array([1.0, 2, 3, 0, 0, 0.5]))}
    pipelines.write_poses(p, world, local)
    pose = {r["node_id"]: np.array(r["pose"]).reshape(4, 4) for r in p.table("sensor_frames").collect()}
    assert np.allclose(pose[2] @ local[2], world[2]) and pose[3].ravel().tolist() == before[3]
    p.save("sensor_frames", stage(p.table("sensor_frames").where("node_id = 1")))
    with pytest.raises(pipelines.NotReady):
        pipelines.register(p)


def test_files_in_and_out(spark, project, tmp_path):
    p = project
    assert run(p, "export", "ply", str(tmp_path / "out"), "--where", "labels == 1") == (0, f"{p.cloud('cloud').count() // 2}\n")
    assert run(p, "import", "ply", str(tmp_path / "out" / "cloud.ply"))[0] == 0
    assert p.cloud("cloud").count() == p.cloud("labels").count() // 2
    assert run(p, "export", "e57", str(tmp_path / "e"))[0] == 0 and run(p, "import", "e57", str(tmp_path / "e" / "cloud.e57"))[0] == 0
    assert "cloud_labels" in run(p, "info")[1] and json.loads(run(p, "info", "--json")[1].splitlines()[0])["holds"] == "points"
    assert "import ply" in run(p, "log", "--limit", "5")[1]


def test_passports_by_path(spark, tmp_path):
    p = pipelines.Project(spark, str(tmp_path / "p"))
    p.save("property_definitions", spark.createDataFrame([("d1", "g1", "company", "company name", "Owner", "string"), ("d2", "g2", "tags", "tags", "Owner", "string_array")], "id string, leksikon_guid string, field_name string, name_en string, category string, type string"))
    p.save("passport_property_values", spark.createDataFrame([], "id string, passport_id string, property_id string, leksikon_guid string, sort_order int, value binary"))
    doc = {"metadata": {"document guid": "G", "version number": "2"}, "sections": [{"nameEN": "Owner", "properties": [{"name": "company name", "guid": "g1", "value": "ACME"}, {"name": "tags", "guid": "g2", "values": [{"value": "a"}, {"value": "b"}]}]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    assert run(p, "import", "materialepas", str(tmp_path / "m.json"), "--project-id", "pr") == (0, '{"passports": 1}\n')
    assert json.loads(run(p, "get", "materials.G.company")[1])["value"] == "ACME"
    whole = json.loads(json.loads(run(p, "get", "materials.G")[1])["value"])
    assert whole["version_number"] == "2" and whole["properties"] == {"company": "ACME", "tags": "[…]"}
    assert run(p, "set", "materials.G.properties.company", "Other")[0] == 0 and "Other" in run(p, "get", "materials[0].company")[1]
    assert run(p, "set", "materials.G.version_number", "3")[0] == 0 and run(p, "set", "materials.G.document_guid", "x")[0] == 1
    assert run(p, "del", "materials.G.tags", "--yes")[0] == 0 and run(p, "get", "materials.G.tags")[0] == 1
    assert run(p, "import", "materialepas", str(tmp_path / "m.json"))[0] == 0 and p.table("passport_property_values").count() == 2
    assert run(p, "export", "materialepas", str(tmp_path / "x")) == (0, "1\n") and "ACME" in (tmp_path / "x" / "G.json").read_text()
    assert '"value":""' in run(p, "create", "material")[1].replace(" ", "")


def test_meshes_and_frames_by_path(spark, tmp_path):
    blob = b"mtllib a.mtl\nv 0 0 0\n\0newmtl m\nmap_Kd old.jpg\n"
    m = spark.createDataFrame([("t", "obj_textured", 3, 1, bytearray(blob)), ("p", "ply_binary", 3, 1, bytearray(b"ply"))], "name string, format string, vertex_count long, face_count long, data binary")
    tex = spark.createDataFrame([("t", "x", "jpg", 2, 2, bytearray(b"J"))], "mesh_name string, tex_name string, format string, width int, height int, data binary")
    value = lambda path, t: bytes(v) if isinstance(v := paths.resolve(t, path).first()["value"], bytearray) else v
    t = {"meshes": m, "mesh_texture_data": tex}
    assert value("meshes.t.data", t) == b"mtllib t.mtl\nv 0 0 0\n" and value("meshes.t.material", t) == b"newmtl m\nmap_Kd t_texture.jpg\n" and value("meshes.p.data", t) == b"ply"
    assert json.loads(value("meshes.t", t))["textures"][0]["tex_name"] == "x" and value("meshes.t.texture", t) == b"J" and value("meshes.t.polygon_count", t) == "1"
    for bad in ("meshes.p.material", "meshes.t.nothing"):
        with pytest.raises(paths.PathError):
            value(bad, t)
    f = {"frames": frames(spark)}
    meta = json.loads(value("frames.1", f))
    assert meta["timestamp"] is None and meta["has_depth"] and not meta["has_confidence"] and json.loads(value("frames.2.metadata", f))["timestamp"] == 1.0
    assert json.loads(value("frames.2.pose", f))[3] == 0.1 and value("frames.1.timestamp", f) == "null" and json.loads(value("frames.1.intrinsics", f))["fx"] == 20.0
    with pytest.raises(paths.PathError):
        value("frames.1.color", f)
    pan = {"panoramas": spark.createDataFrame([(1, "a.jpg", -1.0, -1, bytearray(b"J"))], "id long, filename string, timestamp double, node_id long, data binary")}
    assert value("panoramas[0]", pan) == b"J" and json.loads(value("panoramas[0].metadata", pan)) == {"id": 1, "filename": "a.jpg", "timestamp": None, "node_id": None}
    p = pipelines.Project(spark, str(tmp_path / "p"))
    p.save("meshes", m)
    ply = b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nelement face 1\nend_header\n\0\0"
    assert run(p, "set", "meshes.new", stdin=io.BytesIO(ply))[0] == 0 and p.table("meshes").where("name = 'new'").first()["vertex_count"] == 3
    assert run(p, "set", "meshes.bad", "text")[0] == 1 and run(p, "set", "meshes.empty", stdin=io.BytesIO(b"ply\nend_header\n\0"))[0] == 1 and run(p, "del", "meshes.new", "--yes")[0] == 1


def test_codes_payloads_and_bytes(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(codes.code(F.lit("steel"), "material")) == "steel" and value(codes.code(F.lit("Steel"), "material")) is None and value(codes.code_number(F.lit("interval"), "emission_quantity")) == 3 and value(codes.code_number(F.lit("x"), "tristate")) is None
    p = value(codes.read_payload(codes.component_payload(F.lit("window"), style=F.lit("casement"), pane_count=F.lit(2), operable=F.lit(True), swing=F.lit("left"))))
    assert tuple(p) == ("window", "casement", 2, True, None)
    assert value(codes.component_payload(F.lit("wall"))) == '{"component_type":"wall"}' and value(codes.read_payload(F.lit('{"style":"x","swing":"left"}'), F.lit("door"))).swing == "left"
    assert value(codes.read_payload(F.lit(""), F.lit("door"))) is None and value(codes.read_payload(F.lit('{"component_type":"roof"}'))) is None
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],), ([],), ([1.0],), (None,)], "v array<double>").select(codes.pack_doubles("v").alias("b"))
    got = [r[0] for r in d.select(codes.unpack_doubles("b").alias("v")).select(codes.points_of("v")).collect()]
    assert [tuple(x) for x in got[0]] == [(1, 2, 3), (4, 5, 6)] and got[1:] == [[], None, None]


def test_stored_meshes_labels_and_passports(spark):
    mesh = spark.createDataFrame([("a", "old", 3, 1), ("b", "old", 3, 1)], "name string, format string, vertex_count long, face_count long")
    tex = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "mesh_name string, tex_name string")
    out = store.save_mesh({"meshes": mesh, "mesh_texture_data": tex}, mesh.where("name = 'a'").withColumn("format", F.lit("new")), tex.where("mesh_name = 'a' and tex_name = '2'"))
    assert {tuple(r) for r in out["mesh_texture_data"].collect()} == {("a", "2"), ("b", "1")} and {r["name"]: r["format"] for r in out["meshes"].collect()} == {"a": "new", "b": "old"}
    with pytest.raises(ValueError):
        store.save_mesh({}, mesh.withColumn("face_count", F.lit(0).cast("long")))
    labels = spark.createDataFrame([(1, 2, 1, [-1, 4])], "node_id long, width int, height int, labels array<int>")
    from plumbline.sources.exports import read_grey16

    saved = store.save_label_images(spark.createDataFrame([], "node_id long, data binary"), labels).first()
    assert (read_grey16(bytes(saved["data"])).astype(int) - 1).tolist() == [[-1, 4]]
    steps = cells.wall_steps(spark.createDataFrame([(1, 10, 11), (2, 10, -1)], "face int, a int, b int"), spark.createDataFrame([(10, [1, 2]), (11, [2, 3])], "cell int, walls array<int>"))
    assert {r["face"]: tuple(map(tuple, r[1:])) for r in steps.collect()} == {1: ((1,), (3,), (1, 2, 3)), 2: ((1, 2), (), (1, 2))}
    s = vision.shuffled(spark.range(50), 1)
    assert sorted(r[0] for r in s.collect()) == list(range(50)) and [r[0] for r in s.collect()] == [r[0] for r in s.collect()] != list(range(50))
    pts = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, -1.0), (3, float("nan"), 0.0, 1.0), (4, 50.0, 0.0, 1.0)], "point_idx long, x double, y double, z double")
    f = spark.createDataFrame([(k, list(map(float, (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0))), 10.0, 10.0, 5.0, 5.0, 10, 10) for k in (2, 1)], "node_id long, view array<double>, fx double, fy double, cx double, cy double, width int, height int")
    assert [tuple(r) for r in images.seed_views(pts, f).collect()] == [(1, [1, 2])]
