"""Sharding by a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.positions import running_positions
from duelgrid.llm.storage import materialize

#: The first cells hold the top 12 bits of a group's hash; each refinement splits a cell by 8 further bits.
FIRST_SHIFT, STEP = 52, 8
#: Rows of a shard that one task numbers at about.
CELL_ROWS = 500_000


class _Cells:
    """Sums of group sizes over cells of the hash order; a cell is atomic when it holds a single group."""

    def __init__(self, units: DataFrame):
        self.units = units
        self.cells = self._sums(FIRST_SHIFT, None)
        self._index()

    def _sums(self, shift: int, inside: list[int] | None) -> list[tuple[int, int, int, bool]]:
        rows = self.units
        if inside is not None:
            rows = rows.where(F.shiftright("_key", min(shift + STEP, 63)).isin(inside))
        rows = rows.groupBy(F.shiftright("_key", shift).alias("cell")).agg(F.sum("_size").alias("bytes"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        return [(r.low, r.bytes, shift, r.low == r.high) for r in rows.collect()]

    def _index(self) -> None:
        self.cells.sort()
        self.ends = np.cumsum([c[1] for c in self.cells], dtype=np.int64).tolist()
        self.total = self.ends[-1] if self.ends else 0

    def cut_at(self, position: int) -> int:
        """The last known boundary at or before a position: cells up to an index, and no cell split."""
        return bisect.bisect_right(self.ends, position)

    def end(self, count: int) -> int:
        return self.ends[count - 1] if count else 0

    def walk(self, capacity: int, shards: int, fluid: bool, start: int = 0) -> list[int]:
        """Greedy cut positions; `fluid` lets a cut fall inside a cell that isn't atomic (an upper bound of the true cut)."""
        cuts, at = [], start
        for _ in range(shards):
            n = self.cut_at(at + capacity)
            inside = n < len(self.cells) and not self.cells[n][3]
            at = max(at, at + capacity if fluid and inside else self.end(n))
            cuts.append(at)
        return cuts

    def refine(self, ranges: list[tuple[int, int]]) -> bool:
        """Split every cell that isn't atomic and touches one of the position ranges, in one job for each cell width."""
        chosen = set()
        for low, high in ranges:
            for i in range(bisect.bisect_right(self.ends, low), min(bisect.bisect_left(self.ends, high), len(self.cells) - 1) + 1):
                if not self.cells[i][3]:
                    chosen.add(i)
        for shift in {self.cells[i][2] for i in chosen}:
            keys = sorted(self.cells[i][0] >> shift for i in chosen if self.cells[i][2] == shift)
            self.cells += self._sums(max(shift - STEP, 0), keys) if shift > STEP else self._exact(shift, keys)
        self.cells = [c for i, c in enumerate(self.cells) if i not in chosen]
        self._index()
        return bool(chosen)

    def _exact(self, shift: int, keys: list[int]) -> list[tuple[int, int, int, bool]]:
        rows = self.units.where(F.shiftright("_key", shift).isin(keys)).groupBy("_key").agg(F.sum("_size").alias("bytes"))
        return [(r["_key"], r.bytes, 0, True) for r in rows.collect()]


def _bisect(low: int, high: int, good) -> int:
    """The smallest value in (low, high] for which `good` holds; it holds for high."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def minimax_cuts(units: DataFrame, shards: int) -> tuple[list[int], int]:
    """Hash keys at which shards 1.. begin, and the smallest capacity that `shards` contiguous shards can keep.

    `units` has `_key` (the group's hash, which orders the groups) and `_size`. The capacity is found by binary search
    with a greedy check over sums of hash cells; only the cells in which a cut may still lie are split further, so the
    driver sees at most 4096 + a few hundred x 256 sums a round, at any input size. The result is exact.
    """
    cells = _Cells(units)
    total = cells.total
    if not total:
        return [], 0
    while True:
        capacity = _bisect(0, total, lambda c: cells.walk(c, shards, False)[-1] >= total)
        below = _bisect(0, capacity, lambda c: cells.walk(c, shards, True)[-1] >= total) - 1
        if below == capacity - 1 or not cells.refine(list(zip(cells.walk(below + 1, shards, False), cells.walk(capacity, shards, True)))):
            break
    while True:  # within that capacity, cut nearest to an even share of what is left
        at, cuts, aims = 0, [], []
        for left in range(shards, 1, -1):
            aim = at + (total - at) // left
            aims.append((aim - 1, aim + 1))
            furthest = cells.cut_at(at + capacity)
            near = sorted({min(cells.cut_at(aim), furthest), min(cells.cut_at(aim) + 1, furthest)}, key=lambda n: abs(cells.end(n) - aim))
            fits = (n for n in near if cells.end(n) > at and cells.walk(capacity, left - 1, False, cells.end(n))[-1] >= total)
            count = next(fits, furthest)
            at = cells.end(count)
            cuts.append(count)
        if not cells.refine(aims):
            break
    return [cells.cells[n][0] for n in cuts if n < len(cells.cells)], capacity


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of `shards` shards of near equal bytes; rows of equal text stay together.

    Returns the id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot (gapless from 0 in each shard).
    Atomic groups are rows of equal text, ordered by a 64-bit hash; a hash collision only joins two groups. The largest
    shard is as small as contiguous shards allow. A null text counts 0 bytes, is a group of its own and has a null
    checksum; an empty table gives no rows; repeated rows get slots of their own; other columns are not read.
    """
    units = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            F.xxhash64(text_col).alias("_key"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("_size"),
            F.crc32(F.col(text_col).cast("binary")).alias("_crc"),
        ),
        "shard-units",
    )
    cuts, _ = minimax_cuts(units, shards)
    shard = F.lit(0)
    for key in cuts:
        shard = shard + (F.col("_key") >= F.lit(key)).cast("int")
    cells = max(512, units.count() // (shards * CELL_ROWS))
    placed = running_positions(units.withColumn("_shard", shard), ["_shard"], ["_id", "_key"], cells=cells)
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        F.col("_pos").alias("slot"),
    )
