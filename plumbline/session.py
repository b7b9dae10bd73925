"""Session settings, and cutting lineage through files that survive a lost executor."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COUNTER = itertools.count()


def build_session(master: str = "local[*]", app: str = "plumbline", **conf: str) -> SparkSession:
    """A session with the settings the library is tested with; `conf` overrides them (dots as `__`)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a local one where it is unset and everything runs on one
    machine (tests). ValueError on a cluster without one, as files in local folders would be lost to other executors."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once as parquet into the shared folder and read it back: lineage ends here, and losing an
    executor costs nothing. The files go when the application ends (or earlier by `unstage`)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline/{spark.sparkContext.applicationId}-{next(_COUNTER)}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files behind a `stage` result that nothing reads any more."""
    if path := getattr(df, "_plumbline_path", None):
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """`df` split by columns into as many tasks as a shuffle of this session makes, for steps that cost much per byte:
    adaptive execution merges partitions by bytes and would leave a little text that is costly to work on to one task.
    The number keeps it from that, and hashing the columns once more keeps the step from being merged into a shuffle
    by the same columns before it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))
