"""Mixing sources to target weights with fixed-length blocks and per-source index permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.positions import running_positions
from duelgrid.llm.storage import materialize

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Slots that one row of the slot table expands to at most.
CHUNK = 4096
#: Slots, and rows of a source, that one task handles at about.
TASK_SLOTS, CELL_ROWS = 500_000, 500_000
SEED = 20_240_607


def fill_unit(sources: DataFrame, total: float, most: float) -> float:
    """The target of a unit of weight such that all targets, none above `most` times its source's size, add up to `total`.

    `sources` has `_weight` and `source_size`. A source that its weight would carry over its limit stays at the limit, and
    what it leaves is shared by weight again: the unit only grows, so each round is one sum over the sources.
    """
    unit, stopped, over = 0.0, -1, F.lit(0)
    while True:
        row = sources.agg(
            F.coalesce(F.sum(F.when(over == 1, most * F.col("source_size"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(over == 0, F.col("_weight"))), F.lit(0.0)).alias("free"),
            F.sum(over).alias("n"),
        ).first()
        if not row["free"] or row["n"] == stopped:
            return unit
        unit, stopped = max(unit, max(total - row["held"], 0.0) / row["free"]), row["n"]
        over = (unit * F.col("_weight") > most * F.col("source_size")).cast("int")


def draw_counts(slots: int, shards: int, seed: list[int]) -> np.ndarray:
    """How many of a source's slots each output shard gets: a multinomial draw, which adds up to `slots`.

    Drawn for each source, the sources' counts in a shard are a multinomial draw of the shard's slots by the sources' slots.
    """
    return np.random.Generator(np.random.PCG64(seed)).multinomial(slots, np.full(shards, 1 / shards))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a four-round Feistel network with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    value, limit, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    going = np.ones(len(value), bool)
    while going.any():
        left, right, keys, bits, mask = value[going] >> half[going], value[going] & low[going], key[going], half[going], low[going]
        for turn in range(4):
            mixed = (right + keys + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        value[going] = left << bits | right
        going = value >= limit
    return value.astype(np.int64)


def plan_mix(sized: DataFrame, block: int, share: float, most: float) -> DataFrame:
    """What each source gives: (_source, _number, source_size, rows, target, blocks, slots), planned in Spark.

    Sources are numbered by code point, null last: a range sort, and row numbers after those of the partitions before.
    """
    sums = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = [F.col("_source").isNull(), F.col("_source")]
    ranked = materialize(sums.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sources")
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1 + F.col("_before")
    ranked = ranked.join(counts.select("_part", before.alias("_before")), "_part").withColumn("_number", number.cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_number") % len(WEIGHTS) + 1).cast("int"))
    ranked = materialize(ranked.select("_source", "_number", "source_size", "rows", weight.alias("_weight")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit = fill_unit(ranked, min(share, most) * total, most) if total else 0.0
    planned = ranked.withColumn("target", F.least(F.lit(unit) * F.col("_weight"), most * F.col("source_size")))
    planned = planned.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    slots = F.least(F.rint(F.col("target") * F.col("blocks") / F.col("source_size")), F.floor(most * F.col("blocks"))).cast("long")
    return materialize(planned.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0)).drop("_weight"), "plan")


def slot_table(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, slot, source number, block): every slot of the mix and the block it takes.

    A source's slots are counted through all shards; slot j takes block perm(j mod blocks) of pass j div blocks, with a
    permutation of its own for each source and pass, so no block is taken again before all others have been. Runs of
    slots are cut into chunks and dealt over as many tasks as the number of slots asks for.
    """

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple[int, int, int, int, int]] = []
            for number, slots, blocks in zip(*(c.to_pylist() for c in part.columns)):
                counts = draw_counts(slots, shards, [seed, number])
                firsts = np.cumsum(counts) - counts
                out += [(shard, number, int(firsts[shard]), int(counts[shard]), blocks) for shard in np.flatnonzero(counts).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate([pa.int32(), *[pa.int64()] * 4])], names=["shard", "number", "first", "count", "blocks"])

    total = plan.agg(F.sum("slots")).first()[0] or 0
    tasks = max(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SLOTS))
    table = plan.where("slots > 0").select("_number", "slots", "blocks").mapInArrow(draw, "shard int, number long, first long, count long, blocks long")
    table = table.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {CHUNK}"))))
    table = table.repartition(tasks, "shard", "number", "_part")
    table = table.withColumn("slot", F.explode(F.sequence(F.col("_part") * CHUNK, F.least((F.col("_part") + 1) * CHUNK, F.col("count")) - 1)))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            first, slot, number, blocks = (part.column(i).to_numpy() for i in (1, 2, 3, 4))
            turn, index = np.divmod(first + slot, blocks)
            block = permute(index, blocks, turn * 1_000_003 + number * 7919 + seed)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(block)], names=["shard", "slot", "number", "block"])

    return table.select("shard", "first", "slot", "number", "blocks").mapInArrow(place, "shard int, slot long, number long, block long")


def mix_sources(docs: DataFrame, block: int = 64, share: float = 1.5, most: float = 2.0, shards: int = 24, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of every row the mix takes: id, size, source_size, target (its source's) and taken.

    Words are `[^\\x20\\x09-\\x0D]+`. The words of a source, its rows in hash order, form one stream that is packed into
    blocks of `block` words. Output shards draw multinomial counts of slots a source; slots map to blocks through the
    source's permutations; blocks meet the slots by index. A source's slots are its target's share of its blocks, so
    the words taken come within about one block of the target, and no block, hence no row, is taken more than `most`
    times. The same rows and seed give the same mix. Null text: size 0, taken 0. A null source is a source of its own,
    after all others. Rows that repeat an id are rows of their own. Sources are planned in Spark, as many as there
    are, and their rows are spread by hash cells, so one source may hold any part of the rows. An empty table gives no rows;
    other columns are not read.
    """
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), count_words(F.col(text_col)).alias("_size"))
    met = mix_sized(materialize(sized, "sized"), block, share, most, shards, seed)
    return met.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "taken")


def count_words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_sized(sized: DataFrame, block: int = 64, share: float = 1.5, most: float = 2.0, shards: int = 24, seed: int = SEED) -> DataFrame:
    """`mix_sources` over rows whose words are counted (_id, _source, _size); other columns are kept. Adds source_size, target, taken."""
    plan = plan_mix(sized, block, share, most)
    rows = plan.agg(F.sum("rows")).first()[0] or 0
    sources = plan.select(F.col("_source").alias("_of"), "_number", "source_size", "target")
    numbered = sized.join(sources, sized["_source"].eqNullSafe(sources["_of"])).drop("_source", "_of")
    placed = materialize(running_positions(numbered, ["_number"], ["_id", "_size"], "_size", cells=max(256, rows // CELL_ROWS)), "placed")
    taken = slot_table(plan, shards, seed).groupBy("number", "block").agg(F.count(F.lit(1)).alias("_times"))
    first, last = F.expr(f"_start div {block}"), F.expr(f"(_start + _size - 1) div {block}")
    parts = placed.where("_size > 0").withColumn("_block", F.explode(F.sequence(first, last)))
    inside = F.least((F.col("_block") + 1) * block, F.col("_start") + F.col("_size")) - F.greatest(F.col("_block") * block, F.col("_start"))
    # the sizes of these two sides grow alike; neither is to be broadcast
    met = parts.hint("merge").join(taken, (parts["_number"] == taken["number"]) & (parts["_block"] == taken["block"]))
    sums = met.groupBy("_number", "_pos").agg(F.sum(inside * F.col("_times")).alias("taken"))
    return placed.join(sums, ["_number", "_pos"], "left").drop("_number", "_pos", "_start").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
