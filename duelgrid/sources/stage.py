"""Derived tables written once a session, in the folder all executors share, and read back with column pruning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, tuple[str, object]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all run on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("duelgrid.shared.dir", None)
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="duelgrid-")
        spark.conf.set("duelgrid.shared.dir", named)
    return named.rstrip("/")


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: what tells whether it changed."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def write_once(df: DataFrame, name: str) -> str:
    """The folder of `df` written as Parquet in the shared folder; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/duelgrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back, for small results of large scans that are read several times."""
    return df.sparkSession.read.schema(df.schema).parquet(write_once(df, name))


def staged(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that `build` derives from the tables in `paths`, derived once for each state of these files."""
    key = (spark.sparkContext.applicationId, name, tuple(state_of(spark, p) for p in paths))
    if key not in _WRITTEN:
        made = build()
        _WRITTEN[key] = (write_once(made, name), made.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)
