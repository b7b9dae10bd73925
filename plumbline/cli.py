"""Command line over a project folder (one parquet table per name).

    python -m plumbline.cli FOLDER get 'clouds.scan*.point_count'
    python -m plumbline.cli FOLDER set projects.p1.name "New name"
    python -m plumbline.cli FOLDER del 'clouds.scan*' --force --yes
    python -m plumbline.cli FOLDER import ply scan.ply
    python -m plumbline.cli FOLDER create planes --where 'labels in [1, 2]'
    python -m plumbline.cli FOLDER edit downsample 0.1 --with normals --with labels:few
    python -m plumbline.cli FOLDER register --dry-run
    python -m plumbline.cli FOLDER export ply out
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import passports, store, vision
from plumbline.plans import paths, pipelines
from plumbline.session import build_session, stage
from plumbline.sources import cloudfiles, e57, exports, photos, sqlite

#: The table behind each collection.
TABLES = {"clouds": "point_clouds", "meshes": "meshes", "frames": "sensor_frames", "labels": "segmentation_images", "log": "pipeline_log", "materials": "material_passports", "panoramas": "panoramic_images", "projects": "projects"}
#: What may be changed of a project, and of a passport beside its properties.
PROJECT_FIELDS = ("name", "building_address", "year_of_construction", "survey_date", "survey_organisation", "notes")
PASSPORT_FIELDS = ("created_at", "version_number", "revised_at", "version_date")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a project folder by name."""
    return {p.name.removesuffix(".parquet"): spark.read.parquet(str(p)) for p in sorted(Path(folder).iterdir()) if p.name.endswith(".parquet")}


def collections(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The collections there are, and the tables behind their properties."""
    more = {n: tables[n] for n in ("mesh_texture_data", "passport_property_values", "property_definitions") if n in tables}
    return {c: tables[t] for c, t in TABLES.items() if t in tables} | more


def show(df: DataFrame, out, pretty: bool = False) -> None:
    """Rows as JSON, one a line; bytes of a single value as they are, if the output takes them."""
    for r in df.toLocalIterator():
        d = r.asDict(recursive=True)
        if isinstance(d.get("value"), (bytes, bytearray)) and hasattr(out, "buffer"):
            out.buffer.write(d["value"])
        else:
            print(json.dumps({k: v.hex() if isinstance(v, (bytes, bytearray)) else v for k, v in d.items()}, default=str, ensure_ascii=False, indent=2 if pretty else None), file=out)


def payload(inline: str | None, stdin) -> str | bytes:
    """What a set takes: what is piped in wins over the value given; it is bytes if it holds a NUL byte, else text."""
    data = stdin.read() if stdin is not None else None
    if data:
        data = data.encode() if isinstance(data, str) else data
        return data if b"\0" in data else data.decode("utf-8", "replace").removesuffix("\n")
    if inline is None:
        raise ValueError("no value to set")
    return inline


def set_value(tables: dict[str, DataFrame], path: str, value: str | bytes) -> dict[str, DataFrame]:
    """The tables a set changes, anew: a field of a project (one that isn't there is made), a mesh as PLY bytes, a whole passport as JSON, a field or a property of one."""
    p = paths.parse_path(path)
    if p.wild:
        raise paths.PathError("set takes no wildcard")
    if p.item is None:
        raise paths.PathError("set needs an item")
    if p.collection == "meshes" and not p.field:
        return set_mesh(tables, p.item, value)
    if isinstance(value, bytes):
        raise paths.PathError("only a mesh is set from bytes")
    if p.collection == "materials":
        return set_passport(tables, p, value)
    if p.collection != "projects" or len(p.field) != 1:
        raise paths.PathError("only meshes, passports and fields of projects can be set")
    t = tables["projects"]
    if p.field[0] not in PROJECT_FIELDS:
        raise paths.PathError(f"{p.field[0]} can't be changed")
    if not t.where(F.col("id") == p.item).limit(1).count():
        t = store.insert_ignore(t, t.sparkSession.createDataFrame([(p.item,)], "id string"), ["id"])
    return {"projects": store.update_columns(t, F.col("id") == p.item, {p.field[0]: value}, PROJECT_FIELDS)}


def set_mesh(tables: dict[str, DataFrame], name: str, value: str | bytes) -> dict[str, DataFrame]:
    data = value.encode() if isinstance(value, str) else value
    if not data.startswith(b"ply"):
        raise paths.PathError("a mesh is set from PLY bytes")
    head = data[: data.index(b"end_header")].decode("ascii", "replace").split("\n")
    count = {w[1]: int(w[2]) for h in head if (w := h.split())[:1] == ["element"]}
    spark = next(iter(tables.values())).sparkSession
    row = spark.createDataFrame([(name, "ply_binary", count.get("vertex", 0), count.get("face", 0), bytearray(data))], "name string, format string, vertex_count long, face_count long, data binary")
    return {"meshes": store.save_mesh({"meshes": tables["meshes"]} if "meshes" in tables else {}, row)["meshes"]}


def set_passport(tables: dict[str, DataFrame], p: paths.ResourcePath, value: str) -> dict[str, DataFrame]:
    t = tables["material_passports"]
    if not p.field:
        spark = t.sparkSession
        props, _ = passports.from_json(spark.createDataFrame([(1, value)], "record_id long, body string"))
        d = tables["property_definitions"].groupBy("name_en").agg(F.min(F.struct("id", "leksikon_guid", "field_name")).alias("d")).select(F.col("name_en").alias("name"), "d.*")
        v = props.join(d, "name").select(F.concat(F.lit(p.item), F.lit("-"), "id").alias("id"), F.lit(p.item).alias("passport_id"), F.col("id").alias("property_id"), "leksikon_guid", "field_name", "sort_order", F.encode("text", "UTF-8").alias("value"))
        row = spark.createDataFrame([(p.item, p.item)], "id string, document_guid string")
        names = ("material_passports", "passport_property_values", "passport_log", "property_definitions")
        return store.replace_passport({n: tables[n] for n in names if n in tables}, row, v)
    hit = F.col("document_guid") == p.item
    field = p.field[-1] if p.field[0] == "properties" and len(p.field) > 1 else p.field[0]
    if field == "document_guid":
        raise paths.PathError("document_guid can't be changed")
    if field in PASSPORT_FIELDS:
        return {"material_passports": store.update_columns(t, hit, {field: value}, PASSPORT_FIELDS, must_exist=True)}
    found = t.where(hit).select("id").first()
    if found is None:
        raise paths.PathError(f"no passport {p.item!r}")
    v, d = store.set_property(tables["passport_property_values"], tables["property_definitions"], found["id"], field, value)
    return {"passport_property_values": v, "property_definitions": d}


def delete(tables: dict[str, DataFrame], path: str, force: bool) -> tuple[dict[str, DataFrame], list[str]]:
    """Tables without the items a path names (or without one property of a passport), and what goes."""
    p = paths.parse_path(path)
    if p.collection == "materials" and p.field:
        found = tables["material_passports"].where(F.col("document_guid") == p.item).select("id").first()
        if found is None:
            raise paths.PathError(f"no passport {p.item!r}")
        return dict(tables, passport_property_values=store.delete_property(tables["passport_property_values"], tables["property_definitions"], found["id"], p.field[-1])), [path]
    if p.collection in ("meshes", "projects"):
        raise paths.PathError(f"{p.collection} can't be deleted")
    gone = paths.check_delete(collections(tables), path, force)
    key = paths.COLLECTIONS[p.collection][0]
    return store.delete_cascade(tables, TABLES[p.collection], F.col(key).cast("string").isin(gone)), gone


# ---- import and export


def import_(p: pipelines.Project, what: str, source: str, project_id: str | None = None) -> dict[str, int]:
    """Files into the project: `rtabmap` frames, `ply` and `e57` clouds (with normals and labels they have), `photos` and `360` pictures joined to frames in time, `materialepas` passports."""
    spark = p.spark
    if what == "rtabmap":
        new = sqlite.read_slam_frames(spark, [source])
        old = p.table("sensor_frames")
        out = stage(new if old is None else store.save_frames(old, new))
        p.save("sensor_frames", out)
        return {"frames": out.count()}
    if what in ("ply", "e57"):
        pts = stage(cloudfiles.read_clouds(spark, source) if what == "ply" else e57.read_e57(spark, source))
        made = cloudfiles.clouds_of(pts) if what == "ply" else {"colour": pts.select("cloud", "point_idx", "x", "y", "z", "r", "g", "b"), "normals": pts.where("nx is not null").select("cloud", "point_idx", "nx", "ny", "nz", F.lit(0.0).alias("curvature"))}
        out = {}
        for kind, c in made.items():
            for r in c.groupBy("cloud").agg(F.count("*").alias("n")).collect():  # one row per file
                name = r["cloud"] + {"colour": "", "normals": "_normals", "labels": "_labels"}[kind]
                p.save_cloud(name, c.where(F.col("cloud") == r["cloud"]).drop("cloud"))
                out[name] = r["n"]
        return out
    if what in ("photos", "360"):
        frames = p.table("sensor_frames")
        if frames is None:
            frames = spark.createDataFrame([], "node_id long, timestamp double")
        name = "photos" if what == "photos" else "panoramic_images"
        old = p.table(name)
        if what == "photos":
            new = photos.photos_with_frames(photos.read_photos(spark, source), frames).withColumn("project_id", F.lit(project_id))
            out = new if old is None else store.upsert(old, new, ["filename"])
        else:
            stored = old if old is not None else spark.createDataFrame([], "filename string")
            new = photos.new_panoramas(photos.read_panoramas(spark, source), stored, frames)
            out = new if old is None else old.unionByName(new, allowMissingColumns=True)
        out = stage(out)
        p.save(name, out)
        return {name: out.count()}
    if what == "materialepas":
        body = "\n".join(r[0] for r in spark.read.text(source, wholetext=True).collect())  # one document a user names
        docs = json.loads(body)
        tables = {n: p.table(n) for n in ("material_passports", "passport_property_values", "passport_log", "property_definitions")}
        if any(tables[n] is None for n in ("passport_property_values", "property_definitions")):
            raise pipelines.NotReady("property definitions and values are needed")
        if tables["material_passports"] is None:
            tables["material_passports"] = spark.createDataFrame([], "id string, document_guid string, created_at string, version_number string, project_id string")
        n = 0
        for doc in docs if isinstance(docs, list) else [docs]:
            meta = doc.get("metadata") or {}
            guid = meta.get("document guid") or doc.get("document_guid") or f"passport-{n}"
            new = set_passport({k: t for k, t in tables.items() if t is not None}, paths.ResourcePath("materials", None, guid), json.dumps(doc))
            tables |= {k: stage(t) for k, t in new.items()}
            row = {c: v for c, v in (("version_number", meta.get("version number")), ("project_id", project_id)) if v and c in tables["material_passports"].columns}
            if row:
                tables["material_passports"] = stage(store.update_columns(tables["material_passports"], F.col("document_guid") == guid, row))
            n += 1
        for k, t in tables.items():
            if t is not None:
                p.save(k, stage(t))
        return {"passports": n}
    raise ValueError(f"can't import {what!r}")


def export_(p: pipelines.Project, what: str, to: str, name: str = "cloud", where: str | None = None) -> int:
    """The project into files: a cloud (of the points a filter keeps) as `ply` or `e57`, `colmap` text, `semantic-images`, `materialepas` documents, or the `objects` of an upload as JSON lines."""
    if what in ("ply", "e57"):
        c = p.cloud(name)
        if c is None:
            raise pipelines.NotReady(f"no cloud {name}")
        few = pipelines.selected(p, where, name)
        c = (c if few is None else c.join(few, "point_idx", "left_semi")).withColumn("cloud", F.lit(name))
        Path(to).mkdir(parents=True, exist_ok=True)
        if what == "ply":
            return cloudfiles.write_ply(c, to).agg(F.sum("n")).first()[0] or 0
        f = c.orderBy("point_idx").toPandas()  # the format holds a scan in one stream
        Path(to, f"{name}.e57").write_bytes(e57.e57_bytes({name: f.reindex(columns=["x", "y", "z", "r", "g", "b"], fill_value=0)}))
        return len(f)
    if what == "colmap":
        frames = p.table("sensor_frames")
        if frames is None:
            raise pipelines.NotReady("no frames")
        exports.write_scene(exports.camera_scene(frames, p.cloud(name)), to)
        return frames.count()
    if what == "semantic-images":
        got = exports.semantic_pngs(p.table("label_images"))
        Path(to).mkdir(parents=True, exist_ok=True)
        n = 0
        for r in got.toLocalIterator():
            Path(to, r["name"]).write_bytes(bytes(r["data"]))
            n += 1
        return n
    if what == "materialepas":
        v = store.passport_values(p.table("material_passports"), p.table("passport_property_values"), p.table("property_definitions"))
        v = v.groupBy(F.col("document_guid").alias("passport_id"), "field_name").agg(F.max_by("value", "sort_order").alias("text"))
        Path(to).mkdir(parents=True, exist_ok=True)
        n = 0
        for r in passports.to_json(v, p.table("property_definitions")).toLocalIterator():
            Path(to, f"{r['passport_id'].replace('/', '_')}.json").write_text(json.dumps(json.loads(r["document"]), indent=2, ensure_ascii=False))
            n += 1
        return n
    if what == "objects":
        rows = [r.asDict(recursive=True) for r in (p.table("building_components") or p.spark.createDataFrame([], "name string")).drop("metadata").toLocalIterator()]
        tree = exports.object_tree({"speckle_type": "Base", "name": "components", "elements": [{"speckle_type": "Base", **json.loads(json.dumps(r, default=str))} for r in rows]})
        Path(to).parent.mkdir(parents=True, exist_ok=True)
        Path(to).write_text("\n".join(exports.upload_batches(tree)))
        return len(tree)
    raise ValueError(f"can't export {what!r}")


def blank_passport(p: pipelines.Project, guid: str) -> str:
    """A passport document with all defined fields and nothing filled in, stored under the guid."""
    d = p.table("property_definitions")
    one = p.spark.createDataFrame([(guid, "", None)], "passport_id string, field_name string, text string")
    return passports.to_json(one, d, filled="blank").first()["document"]


def annotate(p: pipelines.Project, scorer, schema: str, batch: int = 32, shuffle: bool = False, skip_annotated: bool = False) -> int:
    """Run a scorer (batch of frames to rows) over the frames and keep its rows as `annotations`; frames that have some may be skipped."""
    pipelines.preflight(p, "annotate")
    f = p.table("sensor_frames")
    f = vision.shuffled(f) if shuffle else f
    old = p.table("annotations")
    new = vision.annotate(f, scorer, schema, old if skip_annotated and old is not None else None, batch)
    out = stage(new if old is None or not skip_annotated else old.unionByName(new))
    p.save("annotations", out)
    return out.count()


def info(p: pipelines.Project) -> list[dict]:
    """A summary of the project: every table with its rows, clouds with their kind, meshes with their sizes."""
    out = []
    for n in p.names():
        t = p.table(n)
        kind = "cloud" if n.startswith("cloud_") else "mesh" if n.startswith("mesh_") else "table"
        holds = "labels" if kind == "cloud" and "label" in t.columns else "normals" if kind == "cloud" and "nx" in t.columns else "points" if kind == "cloud" else ""
        out.append({"name": n, "kind": kind, "holds": holds, "rows": t.count(), "columns": len(t.columns)})
    return out


def create(p: pipelines.Project, a: argparse.Namespace) -> object:
    only = [int(x) for x in a.labels.split(",")] if a.labels else None
    work = {
        "clouds": lambda: pipelines.create_clouds(p, a.grid or 0.05, a.least, a.most, a.step, a.confidence),
        "planes": lambda: pipelines.create_planes(p, a.where, least=a.inliers),
        "rooms": lambda: pipelines.create_rooms(p, a.where, a.grid or 0.5, a.resolution),
        "instances": lambda: pipelines.create_instances(p, a.semantic, a.tolerance, a.smallest, a.largest, only),
        "project": lambda: pipelines.project_labels(p),
        "mesh": lambda: pipelines.create_mesh(p, a.search, a.offset if a.offset is not None else 0.25, a.where),
        "windows": lambda: pipelines.create_windows(p, a.offset or 0.0, not a.poly, only, a.include_internal, a.clear),
        "dense": lambda: pipelines.create_dense(p, a.semantic if a.semantic != "labels" else "dense", a.seed),
        "material": lambda: blank_passport(p, a.guid or "blank"),
    }[a.what]
    return p.run(f"create {a.what}", work, **{k: v for k, v in vars(a).items() if k in ("where", "grid", "offset", "labels") and v is not None})


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="plumbline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("folder")
    sub = a.add_subparsers(dest="verb", required=True)
    for verb in ("get", "del", "set"):
        s = sub.add_parser(verb)
        s.add_argument("path")
        if verb == "set":
            s.add_argument("value", nargs="?")
        if verb == "get":
            s.add_argument("--output")
            s.add_argument("--pretty", action="store_true")
        if verb == "del":
            s.add_argument("--force", action="store_true")
            s.add_argument("--yes", action="store_true")
    s = sub.add_parser("info")
    s.add_argument("--json", action="store_true")
    log = sub.add_parser("log")
    log.add_argument("--limit", type=int, default=0)
    s = sub.add_parser("import")
    s.add_argument("what", choices=["rtabmap", "e57", "ply", "photos", "360", "materialepas"])
    s.add_argument("source")
    s.add_argument("--project-id")
    s = sub.add_parser("export")
    s.add_argument("what", choices=["ply", "e57", "colmap", "semantic-images", "materialepas", "objects"])
    s.add_argument("to")
    s.add_argument("--name", default="cloud")
    s.add_argument("--where")
    s = sub.add_parser("create")
    s.add_argument("what", choices=["clouds", "planes", "rooms", "instances", "project", "mesh", "windows", "dense", "material"])
    for name, kind, default in (("where", str, None), ("grid", float, None), ("least", float, 0.0), ("most", float, 4.0), ("step", int, 4), ("confidence", int, 2), ("inliers", int, 1000), ("resolution", float, 1.0), ("semantic", str, "labels"), ("tolerance", float, 0.5),
                                ("smallest", int, 50), ("largest", int, 1_000_000), ("search", float, 0.6), ("offset", float, None), ("labels", str, None), ("seed", str, None), ("guid", str, None)):
        s.add_argument(f"--{name}", type=kind, default=default)
    for flag in ("poly", "include-internal", "clear"):
        s.add_argument(f"--{flag}", action="store_true")
    s = sub.add_parser("edit")
    s.add_argument("what", choices=["downsample"])
    s.add_argument("resolution", type=float)
    s.add_argument("--with", dest="aligned", action="append", default=[])
    s = sub.add_parser("register")
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("--rounds", type=int, default=10)
    return a


def main(argv: list[str] | None = None, out=sys.stdout, stdin=None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or build_session()
    p = pipelines.Project(spark, args.folder)
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, default=str), file=out)
    try:
        if args.verb == "get":
            got = paths.resolve(collections(load(spark, args.folder)), args.path)
            if args.output:
                with open(args.output, "w") as f:
                    show(got, f, True)
            else:
                show(got, out, args.pretty)
        elif args.verb == "info":
            for r in info(p):
                say(r if args.json else f"{r['name']}\t{r['rows']}")
        elif args.verb == "log":
            show(store.latest_log(p.table("pipeline_log"), args.limit), out)
        elif args.verb == "set":
            for name, rows in set_value(load(spark, args.folder), args.path, payload(args.value, stdin)).items():
                p.save(name, stage(rows))
        elif args.verb == "del":
            tables = load(spark, args.folder)
            left, gone = delete(tables, args.path, args.force)
            print("\n".join(gone), file=out)
            if args.yes or input("delete these? [y/N] ").lower() == "y":
                for n in left:
                    if left[n] is not tables[n]:
                        p.save(n, stage(left[n]))
        elif args.verb == "import":
            say(p.run(f"import {args.what}", lambda: import_(p, args.what, args.source, args.project_id), source=args.source))
        elif args.verb == "export":
            say(export_(p, args.what, args.to, args.name, args.where))
        elif args.verb == "create":
            say(create(p, args))
        elif args.verb == "edit":
            with_ = {n: to or n for n, _, to in (x.partition(":") for x in args.aligned)}
            say(p.run("edit downsample", lambda: pipelines.downsample(p, args.resolution, with_), resolution=args.resolution))
        else:
            say(p.run("register", lambda: pipelines.register(p, rounds=args.rounds, dry_run=args.dry_run)))
    except (paths.PathError, KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(stdin=None if sys.stdin.isatty() else sys.stdin.buffer))
