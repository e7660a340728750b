"""Arrow batches as rows, for functions that run once for each text inside Spark tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handed to a function, and rows in a batch that goes back.
SLICE, OUT_ROWS = 256, 8192


def share(spark: SparkSession, value: object) -> Broadcast:
    """A value for all workers, with the classes of this package it holds, which needn't be installed there."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(held: Broadcast) -> object:
    """The value of `share`; a worker unpacks it once and keeps it for its later tasks."""
    if getattr(held, "unpacked", None) is None:
        held.unpacked = pickle.loads(held.value)
    return held.unpacked


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], Iterable[tuple]]], schema: str) -> DataFrame:
    """For each row, the rows that `make()(row)` gives. `make` runs once for each task and builds what all rows share."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out = make(), []
        for part in parts:
            for at in range(0, part.num_rows, SLICE):
                for row in zip(*(c.to_pylist() for c in part.slice(at, SLICE).columns)):
                    out += work(row)
                    if len(out) >= OUT_ROWS:
                        yield _batch(out, target)
                        out = []
        if out:
            yield _batch(out, target)

    return df.mapInArrow(batches, schema)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
