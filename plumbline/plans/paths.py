"""The resource path language: `clouds.scan*.metadata`, `meshes[0]`, `projects.<id>.name`.

The first component is one of the collections, with an index in brackets or not; the second an item, where `*` stands for any
text; all others are a property. `/` is the same as `.`, and empty components are skipped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import number_rows
from plumbline.operators import store

#: The collections, the key of each and the order its items are listed in.
COLLECTIONS = {
    "clouds": ("name", ("name", "id")), "meshes": ("name", ("name",)), "frames": ("node_id", ("node_id",)), "labels": ("node_id", ("node_id",)),
    "log": ("id", ("id desc",)), "materials": ("document_guid", ("created_at", "document_guid")), "panoramas": ("filename", ("filename",)), "projects": ("id", ("id",)),
}
READ_ONLY = ("frames", "labels", "log")


class PathError(ValueError):
    """The text is no path, or leads nowhere."""


@dataclass(frozen=True)
class ResourcePath:
    collection: str
    index: int | None = None
    item: str | None = None
    field: tuple[str, ...] = ()

    @property
    def wild(self) -> bool:
        return self.item is not None and "*" in self.item


def parse_path(text: str) -> ResourcePath:
    parts = [p for p in re.split(r"[./]", text) if p]
    if not parts:
        raise PathError("a path needs a collection")
    head = re.fullmatch(r"([^\[\]]+)(?:\[([0-9]+)\])?", parts[0])
    if not head:
        raise PathError(f"{parts[0]!r} is no collection with an index")
    if head[1] not in COLLECTIONS:
        raise PathError(f"no collection {head[1]!r}; there are {', '.join(sorted(COLLECTIONS))}")
    if any("[" in p for p in parts[1:]):
        raise PathError("only a collection can have an index")
    index = None if head[2] is None else int(head[2])
    item, rest = (None, parts[1:]) if index is not None else (parts[1] if len(parts) > 1 else None, parts[2:])
    return ResourcePath(head[1], index, item, tuple(rest))


def wildcard_regex(pattern: str) -> str:
    """The anchored regular expression of a pattern in which only `*` is special."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def items(table: DataFrame, collection: str) -> DataFrame:
    """The collection in its listing order, with `item` (the key as text) and `rn` from 1."""
    key, order = COLLECTIONS[collection]
    return number_rows(table.withColumn("item", F.col(key).cast("string")), *(F.col(o.split()[0]).desc() if o.endswith("desc") else F.col(o) for o in order))


def resolve(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """The rows a path names; with a property, (item, value) of it, a JSON document for `metadata`. PathError if a single item
    is not there; a wildcard that matches nothing is an empty result."""
    p = parse_path(path)
    if p.collection not in tables:
        raise PathError(f"this project has no {p.collection}")
    table = tables[p.collection]
    key = COLLECTIONS[p.collection][0]
    if p.index is not None:
        rows = items(table, p.collection).where(F.col("rn") == p.index + 1).drop("rn")
    else:
        rows = table.withColumn("item", F.col(key).cast("string"))
        if p.wild:
            rows = rows.where(F.col("item").rlike(wildcard_regex(p.item)))
        elif p.item is not None and p.collection == "projects" and p.item in table.columns and not p.field:
            first = items(table, "projects").where("rn = 1")  # a field without an id is that of the first project
            return first.select("item", F.col(p.item).cast("string").alias("value"))
        elif p.item is not None:
            rows = rows.where(F.col("item") == p.item)
    if not p.wild and (p.item is not None or p.index is not None) and not rows.limit(1).count():
        raise PathError(f"{path!r} is not there")
    one = p.item is not None or p.index is not None
    if one and p.collection in VIEWS:
        return VIEWS[p.collection](rows, p.field, tables)
    if not p.field:
        return rows
    name = p.field[-1] if p.field[0] == "properties" and len(p.field) > 1 else p.field[0]
    plain = [c for c, t in table.dtypes if t != "binary"]
    if name == "metadata":
        return rows.select("item", F.to_json(F.struct(*plain)).alias("value"))
    if name not in table.columns:
        raise PathError(f"{p.collection} have no property {name!r}")
    return rows.select("item", F.col(name).cast("string").alias("value"))


# ---- what items of single collections show; each gives (item, value), text or bytes


def _has(rows: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in rows.columns]


def _known(name: str, names: list[str], what: str) -> None:
    if name not in names:
        raise PathError(f"{what} have no property {name!r}; there are {', '.join(sorted(names))}")


def split_textured(blob: bytes, name: str) -> tuple[bytes, bytes]:
    """Object and material text of a textured mesh's blob, which the first NUL byte parts; the names of files in them become those of the mesh."""
    obj, _, mtl = bytes(blob).partition(b"\0")

    def lines(text: bytes, key: bytes, to: str) -> bytes:
        return b"".join((key + to.encode() if x.startswith(key) else x) + b"\n" for x in text.removesuffix(b"\n").split(b"\n")) if text else b""

    return lines(obj, b"mtllib ", f"{name}.mtl"), lines(mtl, b"map_Kd ", f"{name}_texture.jpg")


def _meshes(rows: DataFrame, field: tuple[str, ...], tables: dict[str, DataFrame]) -> DataFrame:
    """A mesh alone shows its metadata."""
    name = field[0] if field else "metadata"
    _known(name, ["metadata", "data", "material", "texture", "format", "vertex_count", "polygon_count"], "meshes")
    textures = tables.get("mesh_texture_data")
    if name == "metadata":
        more = [F.col(c) for c in _has(rows, "stage", "parameters", "created_at")]
        j = rows
        if textures is not None:
            t = textures.groupBy(F.col("mesh_name").alias("item")).agg(F.array_sort(F.collect_list(F.struct(*_has(textures, "tex_name", "format", "width", "height")))).alias("textures"))
            j, more = rows.join(t, "item", "left"), [*more, F.when(F.col("format") == "obj_textured", F.col("textures")).alias("textures")]
        return j.select("item", F.to_json(F.struct("name", "format", "vertex_count", F.col("face_count").alias("polygon_count"), *more)).alias("value"))
    if name in ("format", "vertex_count", "polygon_count"):
        return rows.select("item", F.col("face_count" if name == "polygon_count" else name).cast("string").alias("value"))
    if name == "texture":
        if textures is None:
            raise PathError("this project has no textures")
        return rows.select("item").join(textures.select(F.col("mesh_name").alias("item"), "tex_name", "data"), "item").orderBy("item", "tex_name").select("item", F.col("data").alias("value"))
    if name == "material" and rows.where("format <> 'obj_textured'").limit(1).count():
        raise PathError("a mesh without textures has no material")

    def run(parts):
        for f in parts:
            f["value"] = [(d if kind != "obj_textured" else split_textured(d, n)[name == "material"]) for n, kind, d in zip(f.item, f.format, f.data)]
            yield f[["item", "value"]]

    return rows.select("item", "format", "data").mapInPandas(run, "item string, value binary")


def _intrinsics(rows: DataFrame) -> Column:
    return F.struct(*_has(rows, "fx", "fy", "cx", "cy", "width", "height"))


def _time() -> Column:
    return F.when(F.col("timestamp") >= 0, F.col("timestamp"))


def _frames(rows: DataFrame, field: tuple[str, ...], tables: dict[str, DataFrame]) -> DataFrame:
    name = field[0] if field else "metadata"
    _known(name, ["metadata", "color", "image", "depth", "confidence", "pose", "intrinsics", "timestamp"], "frames")
    images = {"color": "color", "image": "color", "depth": "depth", "confidence": "confidence"}
    if name in images:
        if images[name] not in rows.columns or rows.where(F.coalesce(F.length(images[name]), F.lit(0)) == 0).limit(1).count():
            raise PathError(f"a frame has no {images[name]} image")
        return rows.select("item", F.col(images[name]).alias("value"))
    if name == "metadata":
        there = lambda c: (F.coalesce(F.length(c), F.lit(0)) > 0 if c in rows.columns else F.lit(False)).alias(f"has_{c}")
        size = [F.col(c) for c in _has(rows, "width", "height")]
        meta = F.struct("node_id", *([_time().alias("timestamp")] if "timestamp" in rows.columns else []), *size, _intrinsics(rows).alias("intrinsics"), *_has(rows, "pose"), there("depth"), there("confidence"))
        return rows.select("item", F.to_json(meta, {"ignoreNullFields": "false"}).alias("value"))
    value = {"pose": lambda: F.to_json("pose"), "intrinsics": lambda: F.to_json(_intrinsics(rows)), "timestamp": lambda: F.coalesce(_time().cast("string"), F.lit("null"))}[name]()
    return rows.select("item", value.alias("value"))


def _panoramas(rows: DataFrame, field: tuple[str, ...], tables: dict[str, DataFrame]) -> DataFrame:
    """A panorama alone shows its image."""
    name = field[0] if field else "image"
    _known(name, ["metadata", "image"], "panoramas")
    if name == "image":
        return rows.select("item", F.col("data" if "data" in rows.columns else "image").alias("value"))
    node = F.when(F.col("node_id") >= 0, F.col("node_id")).alias("node_id")
    return rows.select("item", F.to_json(F.struct("id", "filename", _time().alias("timestamp"), node), {"ignoreNullFields": "false"}).alias("value"))


def collapsed(value: Column) -> Column:
    """A stored property in a summary: objects and lists are only shown as such."""
    v = F.trim(value)
    return F.when(v.startswith("{"), F.lit("{…}")).when(v.startswith("["), F.lit("[…]")).otherwise(value)


def _materials(rows: DataFrame, field: tuple[str, ...], tables: dict[str, DataFrame]) -> DataFrame:
    """A passport alone shows its metadata and properties; `<guid>.<property>` is `<guid>.properties.<property>`."""
    meta = ["document_guid", "created_at", "version_number"]
    if field and field[0] in meta:
        return rows.select("item", F.col(field[0]).cast("string").alias("value"))
    if "passport_property_values" in tables and "property_definitions" in tables:
        v = store.passport_values(rows, tables["passport_property_values"], tables["property_definitions"]).select(F.col("document_guid").alias("item"), "sort_order", "field_name", "value")
    else:
        v = rows.select(F.col("document_guid").alias("item"), F.lit(0).alias("sort_order"), F.lit("").alias("field_name"), F.lit("").alias("value")).limit(0)
    one = field[1] if len(field) > 1 and field[0] == "properties" else field[0] if field and field[0] != "properties" else None
    if one is not None:
        got = v.where(F.col("field_name") == one)
        if not got.limit(1).count():
            raise PathError(f"no property {one!r} is stored")
        return got.select("item", "value")
    pairs = v.groupBy("item", "field_name").agg(F.min_by("value", "sort_order").alias("value"))
    pairs = pairs.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", collapsed(F.col("value")))))).alias("properties"))
    j = rows.select("item", *_has(rows, *meta)).join(pairs, "item", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))
    return j.select("item", F.to_json("properties" if field else F.struct(*_has(rows, *meta), "properties")).alias("value"))


VIEWS = {"meshes": _meshes, "frames": _frames, "panoramas": _panoramas, "materials": _materials}


def check_delete(tables: dict[str, DataFrame], path: str, force: bool = False, limit: int = 1000) -> list[str]:
    """The items a delete would remove, at most `limit` of them (that many may be confirmed by hand). PathError where a wildcard
    lacks `force`, more than `limit` would go, or the collection is read-only."""
    p = parse_path(path)
    if p.collection in READ_ONLY:
        raise PathError(f"{p.collection} can't be deleted")
    if p.wild and not force:
        raise PathError("a wildcard delete needs force")
    found = [r["item"] for r in resolve(tables, path).select("item").limit(limit + 1).collect()]
    if len(found) > limit:
        raise PathError(f"more than {limit} items")
    return sorted(found)
