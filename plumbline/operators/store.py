"""Changes to tables. A change is a new DataFrame; `replace` puts it in the place of a stored table, whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.voxel import first_per


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows replace those of the same key, whole; missing columns become null. Of several new rows of a key one is taken, the
    greatest by all its columns. Null keys are new rows, as nothing equals null."""
    rows = rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in table.dtypes))
    rest = [c for c in rows.columns if c not in key]
    one = first_per(rows, list(key), *(F.col(c).desc() for c in rest)) if rest else rows.dropDuplicates(list(key))
    return table.join(rows.select(*key).distinct(), list(key), "left_anti").select(*table.columns).unionByName(one)


def insert_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Only rows whose key isn't there yet are added."""
    rows = rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in table.dtypes))
    return table.unionByName(rows.dropDuplicates(list(key)).join(table.select(*key).distinct(), list(key), "left_anti").select(*table.columns))


def update_columns(table: DataFrame, key: Column, values: dict[str, object], allowed: Sequence[str] | None = None, must_exist: bool = False) -> DataFrame:
    """Columns of the rows where `key` holds get new values. ValueError for a column that may not change (or doesn't exist), KeyError
    if a row must be there and none is."""
    if bad := [c for c in values if c not in table.columns or allowed is not None and c not in allowed]:
        raise ValueError(f"can't change {', '.join(bad)}")
    if must_exist and not table.where(key).limit(1).count():
        raise KeyError("no such row")
    types = dict(table.dtypes)
    return table.withColumns({c: F.when(key, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in values.items()})


#: What goes with a deleted row, as (table, column it is referred by in its children).
CASCADES: dict[str, list[tuple[str, str, str]]] = {
    "point_clouds": [("point_cloud_data", "cloud_id", "id"), ("label_definitions", "cloud_id", "id")],
    "sensor_frames": [("segmentation_images", "node_id", "node_id")],
    "meshes": [("mesh_texture_data", "mesh_id", "id")],
    "material_passports": [("passport_property_values", "passport_id", "id"), ("passport_log", "passport_id", "id")],
    "projects": [("material_passports", "project_id", "id"), ("building_components", "project_id", "id")],
}
SET_NULL = {"sensor_frames": [("panoramic_images", "node_id", "node_id")]}


def delete_cascade(tables: dict[str, DataFrame], name: str, condition: Column) -> dict[str, DataFrame]:
    """All tables without the rows of `name` where the condition holds (null doesn't), and without what hangs on them, down the
    graph; references that are only set to null are. Tables that aren't given are passed over."""
    out = dict(tables)

    def drop(table: str, gone: DataFrame) -> None:
        for child, column, key in CASCADES.get(table, []):
            if child in out:
                keys = gone.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
                below = out[child].join(keys, column, "left_semi")
                out[child] = out[child].join(keys, column, "left_anti").select(*out[child].columns)
                drop(child, below)
        for child, column, key in SET_NULL.get(table, []):
            if child in out:
                keys = gone.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
                cols = out[child].columns
                out[child] = out[child].join(keys, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*cols)

    hit = F.coalesce(condition, F.lit(False))
    gone = tables[name].where(hit)
    out[name] = tables[name].where(~hit)
    drop(name, gone)
    return out


def set_property(values: DataFrame, definitions: DataFrame, passport: str, field: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Set one property of a passport: (values, definitions). An unknown field gets a definition `custom:<field>`; a new property comes
    last in order."""
    known = definitions.where(F.col("field_name") == field).agg(F.min(F.struct("id", "leksikon_guid")).alias("d")).first()["d"]
    if known is None:
        guid = f"custom:{field}"
        row = definitions.sparkSession.createDataFrame([(guid, guid, field)], "id string, leksikon_guid string, field_name string")
        definitions = insert_ignore(definitions, row, ["id"])
        known = {"id": guid, "leksikon_guid": guid}
    mine = F.col("passport_id") == passport
    same = mine & (F.col("property_id").eqNullSafe(F.lit(known["id"])) | (F.col("property_id").isNull() & F.col("leksikon_guid").eqNullSafe(F.lit(known["leksikon_guid"]))))
    old = values.where(same).agg(F.min("sort_order").alias("s")).first()["s"]
    order = old if old is not None else (values.where(mine).agg(F.max("sort_order").alias("s")).first()["s"] or 0) + 1
    row = values.sparkSession.createDataFrame([(str(uuid.uuid4()), passport, known["id"], known["leksikon_guid"], int(order), text.encode())],
                                              "id string, passport_id string, property_id string, leksikon_guid string, sort_order int, value binary")
    return values.where(~F.coalesce(same, F.lit(False))).unionByName(row, allowMissingColumns=True), definitions


def delete_property(values: DataFrame, definitions: DataFrame, passport: str, field: str) -> DataFrame:
    """The values without one property of a passport."""
    d = definitions.where(F.col("field_name") == field)
    gone = values.where(F.col("passport_id") == passport).join(d.select(F.col("id").alias("property_id")), "property_id", "left_semi").select("id")
    by_guid = values.where((F.col("passport_id") == passport) & F.col("property_id").isNull()).join(d.select("leksikon_guid").where("leksikon_guid is not null"), "leksikon_guid", "left_semi").select("id")
    return values.join(gone.unionByName(by_guid).distinct(), "id", "left_anti").select(*values.columns)


def log_start(log: DataFrame, stage_name: str, parameters: str = "{}") -> tuple[DataFrame, int]:
    """The log with a running entry, and its id."""
    new = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"] + 1
    row = log.sparkSession.range(1).select(F.lit(new).alias("id"), F.lit(stage_name).alias("stage"), F.current_timestamp().alias("started_at"), F.lit(parameters).alias("parameters"), F.lit("running").alias("status"))
    return log.unionByName(row.select(*(F.col(c).cast(dict(log.dtypes)[c]).alias(c) for c in row.columns if c in log.columns)), allowMissingColumns=True), new


def log_end(log: DataFrame, id_: int, status: str = "success", error: str | None = None) -> DataFrame:
    """The log with the entry ended; a failed stage is marked, too."""
    hit = F.col("id") == id_
    return log.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status"))).withColumn("error_msg", F.when(hit, F.lit(error)).otherwise(F.col("error_msg"))).withColumn(
        "finished_at", F.when(hit, F.current_timestamp().cast(dict(log.dtypes)["finished_at"])).otherwise(F.col("finished_at")))


def latest_log(log: DataFrame, n: int = 0) -> DataFrame:
    """Newest first; all entries for n = 0."""
    out = log.orderBy(F.desc("id"))
    return out.limit(n) if n else out


def replace(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Put `df` in the place of a stored parquet table. The new files are written beside the old ones and the folders then swapped by
    renaming, so readers see the old table or the new one; a crash before the swap leaves the old one."""
    spark: SparkSession = df.sparkSession
    path = path.rstrip("/")
    fresh, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(fresh)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(fresh), p(path))
    fs.delete(p(old), True)


def save_cloud(points: DataFrame, path: str, name: str) -> None:
    """Points of one cloud into a table partitioned by `cloud`; the cloud's old points go, others stay."""
    points.withColumn("cloud", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cloud").parquet(path)


def cloud_chunks(rows: DataFrame, most: int = 1 << 28) -> DataFrame:
    """(name, chunk_index, data) of (name, data): blobs cut into chunks of at most `most` bytes, at least one each."""
    n = F.greatest(F.lit(1), F.ceil(F.length("data") / most).cast("int"))
    return rows.select("name", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index")).select("name", "chunk_index", F.expr(f"substring(data, chunk_index * {most} + 1, {most})").alias("data"))


def join_chunks(chunks: DataFrame, key: str = "name") -> DataFrame:
    """(key, data) of chunks in the order of chunk_index; of repeated chunks the first is taken."""
    one = first_per(chunks.select(key, "chunk_index", "data"), [key, "chunk_index"], "data")
    got = F.array_sort(F.collect_list(F.struct("chunk_index", "data")))
    return one.groupBy(key).agg(F.aggregate(got, F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x["data"], F.lit(b"")))).alias("data"))


def first_property_number(values: DataFrame) -> DataFrame:
    """(passport_id, next_sort_order): the number a new property would get."""
    return values.groupBy("passport_id").agg((F.coalesce(F.max("sort_order"), F.lit(0)) + 1).cast("int").alias("next_sort_order"))


def sort_numbers(values: DataFrame) -> DataFrame:
    """Values numbered anew from 0 within their passport, in their present order."""
    return values.withColumn("sort_order", (F.row_number().over(Window.partitionBy("passport_id").orderBy("sort_order", "id")) - 1).cast("int"))


def save_mesh(tables: dict[str, DataFrame], mesh: DataFrame, textures: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables with meshes (name, format, vertex_count, face_count, data, ...) put in or replaced by name, and their textures (mesh_name, tex_name, format,
    width, height, data) by mesh and texture name. ValueError if one of the meshes is empty: no vertices or no faces."""
    if mesh.where("coalesce(vertex_count, 0) = 0 or coalesce(face_count, 0) = 0").limit(1).count():
        raise ValueError("an empty mesh is not stored")
    out = dict(tables, meshes=upsert(tables["meshes"], mesh, ["name"]) if "meshes" in tables else mesh)
    if textures is not None:
        # a mesh that is stored anew loses textures it has no more
        old = tables["mesh_texture_data"].join(mesh.select(F.col("name").alias("mesh_name")), "mesh_name", "left_anti").select(*tables["mesh_texture_data"].columns) if "mesh_texture_data" in tables else None
        more = [F.col(c) for c in textures.columns if c not in ("mesh_name", "tex_name")]
        one = first_per(textures, ["mesh_name", "tex_name"], *more) if more else textures.distinct()
        out["mesh_texture_data"] = one if old is None else old.unionByName(one, allowMissingColumns=True)
    return out


def save_frames(frames: DataFrame, new: DataFrame) -> DataFrame:
    """Sensor frames (node_id and images, pose, intrinsics) put in or replaced by node_id."""
    return upsert(frames, new, ["node_id"])


def save_label_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Segmentation images (node_id, data) with those of `labels` (node_id, width, height, labels array<int>, row by row, -1 for background) put in or replaced, each as a 16-bit grey
    PNG of label + 1."""
    import numpy as np
    import pandas as pd

    from plumbline.sources.exports import label_png

    def run(parts):
        for f in parts:
            yield pd.DataFrame({"node_id": f.node_id, "data": [label_png(np.array(x).reshape(h, w)) for x, w, h in zip(f.labels, f.width, f.height)]})

    return upsert(images, labels.select("node_id", "width", "height", "labels").mapInPandas(run, f"node_id {dict(labels.dtypes)['node_id']}, data binary"), ["node_id"])


def replace_passport(tables: dict[str, DataFrame], passport: DataFrame, values: DataFrame, log: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables with passports (id, document_guid, ...) put in the place of those of the same document_guid: the old row, its values and its log go, the new ones
    come, and definitions the values name by `field_name` that aren't there yet are added. Nothing is written here, so a failure changes nothing;
    the tables are then put in place by `replace`."""
    old = tables["material_passports"].join(passport.select("document_guid").distinct(), "document_guid", "left_semi").select(F.col("id").alias("passport_id"))
    gone = old.unionByName(passport.select(F.col("id").alias("passport_id"))).where("passport_id is not null").distinct()
    out = dict(tables)
    out["material_passports"] = upsert(tables["material_passports"].join(passport.select("document_guid"), "document_guid", "left_anti").select(*tables["material_passports"].columns), passport, ["id"])
    for name, rows in (("passport_property_values", values), ("passport_log", log)):
        if name in tables:
            kept = tables[name].join(gone, "passport_id", "left_anti").select(*tables[name].columns)
            types = dict(tables[name].dtypes)
            out[name] = kept if rows is None else kept.unionByName(rows.select(*(F.col(c).cast(types[c]).alias(c) if c in rows.columns else F.lit(None).cast(types[c]).alias(c) for c in types)))
    if "property_definitions" in tables and "field_name" in values.columns:
        new = values.where("field_name is not null").select(F.col("property_id").alias("id"), F.col("leksikon_guid"), "field_name").where("id is not null").distinct()
        out["property_definitions"] = insert_ignore(tables["property_definitions"], new, ["id"])
    return out


def passport_entries(passports_: DataFrame, log: DataFrame, guid: str | None = None) -> DataFrame:
    """The log of passports by document_guid, of one or of all, in the order of editing: (document_guid, entry_type, target_guid, edited_by, edited_at, old_value, new_value)."""
    p = passports_.select(F.col("id").alias("passport_id"), "document_guid")
    j = log.join(p if guid is None else p.where(F.col("document_guid") == guid), "passport_id")
    return j.select("document_guid", "entry_type", "target_guid", "edited_by", "edited_at", "old_value", "new_value").orderBy("document_guid", "edited_at")


def passport_values(passports_: DataFrame, values: DataFrame, definitions: DataFrame, guid: str | None = None) -> DataFrame:
    """The stored properties of passports by document_guid, of one or of all, in their order: (document_guid, sort_order, field_name, value). A value belongs to the definition of its
    property_id or, without one, of its leksikon_guid."""
    p = passports_.select(F.col("id").alias("passport_id"), "document_guid")
    v = values.join(p if guid is None else p.where(F.col("document_guid") == guid), "passport_id").withColumn("k", F.coalesce(F.concat(F.lit("i"), "property_id"), F.concat(F.lit("g"), "leksikon_guid")))
    d = definitions.select(F.concat(F.lit("i"), "id").alias("k"), "id", "field_name").unionByName(definitions.select(F.concat(F.lit("g"), "leksikon_guid").alias("k"), "id", "field_name"))
    d = d.where("k is not null").groupBy("k").agg(F.min_by("field_name", "id").alias("field_name"))
    return v.join(d, "k").select("document_guid", "sort_order", "field_name", F.decode(F.col("value"), "UTF-8").alias("value")).orderBy("document_guid", "sort_order")
