"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all run on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("duelgrid.shared.dir", None)
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="duelgrid-")
        spark.conf.set("duelgrid.shared.dir", named)
    return named.rstrip("/")


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/duelgrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder, store = _folder(spark, path)
    store.deleteOnExit(folder)
    return path, spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back; the files go when the application ends.

    The written table survives lost executors and is read with column pruning by every later pass.
    """
    return _write(df, name)[1]


class Scratch:
    """Written tables of one computation, which go as soon as it has written what it gives back."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, read = _write(df, name)
        self.tables.append((df.sparkSession, path))
        return read

    def clear(self) -> None:
        for spark, path in self.tables:
            folder, store = _folder(spark, path)
            store.delete(folder, True)
        self.tables = []


#: The bits of a key filter are 2 to this power: 1 MB, whatever the number of keys.
FILTER_BITS = 23


def keep_possible(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose long `key` may be among `keys` (same column), before they are shuffled to meet these exactly.

    One bit a key in a bitmap of fixed size, which is broadcast as one row; a table of very many keys fills it, and then
    more rows pass, never fewer than should.
    """
    spark, mixed = rows.sparkSession, F.xxhash64(F.lit(3), key)
    place = F.pmod(F.shiftright(mixed, 6), F.lit(1 << (FILTER_BITS - 6))).cast("int")
    words = keys.groupBy(place.alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64(3, {key}) & 63 as int))")).alias("word")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["at"].to_numpy()] = words["word"].to_numpy()
    bitmap = spark.createDataFrame(pa.table({"_bits": pa.array([table])}))
    test = F.expr(f"(shiftrightunsigned(_bits[cast(pmod(shiftright(xxhash64(3, {key}), 6), {1 << (FILTER_BITS - 6)}) as int)], cast(xxhash64(3, {key}) & 63 as int)) & 1) = 1")
    return rows.crossJoin(F.broadcast(bitmap)).where(test).drop("_bits")
