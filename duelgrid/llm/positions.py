"""Gapless positions and running totals inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.storage import materialize


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"{c}_of"]) for c in names))


def running_positions(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, cells: int = 256) -> DataFrame:
    """Add `_pos` (0.. without gaps in each group) and, with `weight`, `_start` (sum of the weights before the row).

    Rows that are equal in keys, order and weight are one unit of so many rows. Units are spread over `cells` hash cells
    of `order`; windows run over the units of a cell, so no group, however large or repetitive, meets in one task. Cell
    totals (groups x cells rows) give each cell its offset. Repeats are numbered inside the partitions they were written
    in, which follow one another. The order inside a group is by cell, then by `order`: the same rows always get the same
    positions, and repeats share theirs out. Null is a value; key columns must not be null.
    """
    names = list(dict.fromkeys([*keys, *order, *([weight] if weight else [])]))
    rows = materialize(df.withColumns({"_written": F.spark_partition_id(), "_line": F.monotonically_increasing_id()}), "rows")
    parts = rows.groupBy(*names, "_written").agg(F.count(F.lit(1)).alias("_units"))
    units = parts.groupBy(*names).agg(F.sum("_units").alias("_repeats")).withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    total = F.col("_repeats") * F.col(weight) if weight else F.lit(0)
    inside = Window.partitionBy(*keys, "_cell").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    units = units.withColumn("_total", total).withColumns({"_pos": before("_repeats", inside), "_start": before("_total", inside)})
    totals = units.groupBy(*keys, "_cell").agg(F.sum("_repeats").alias("_units"), F.sum("_total").alias("_w"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_cell", before("_units", earlier).alias("_rows0"), before("_w", earlier).alias("_sum0"))
    units = units.join(offsets, [*keys, "_cell"])
    units = materialize(units.select(*(F.col(c).alias(f"{c}_of") for c in names), "_repeats", (F.col("_pos") + F.col("_rows0")).alias("_pos"), (F.col("_start") + F.col("_sum0")).alias("_start")), "units")
    once = units.where("_repeats = 1")
    out = rows.join(once, _same(rows, once, names)).select(*df.columns, "_pos", "_start")
    many = units.where("_repeats > 1")
    if not many.isEmpty():
        held = rows.join(many, _same(rows, many, names)).select(*df.columns, "_written", "_line", "_pos", "_start")
        here = F.row_number().over(Window.partitionBy(*names, "_written").orderBy("_line")) - 1
        ahead = before("_units", Window.partitionBy(*names).orderBy("_written").rowsBetween(Window.unboundedPreceding, -1))
        ahead = parts.select(*(F.col(c).alias(f"{c}_of") for c in names), F.col("_written").alias("_written_of"), ahead.alias("_ahead"))
        held = held.withColumn("_inner", here)
        held = held.join(ahead, _same(held, ahead, [*names, "_written"])).withColumn("_inner", F.col("_inner") + F.col("_ahead"))
        start = F.col("_start") + F.col("_inner") * (F.col(weight) if weight else F.lit(0))
        out = out.unionByName(held.select(*df.columns, (F.col("_pos") + F.col("_inner")).alias("_pos"), start.alias("_start")))
    out = out.withColumns({"_pos": F.col("_pos").cast("long"), "_start": F.col("_start").cast("long")})
    return out if weight else out.drop("_start")
