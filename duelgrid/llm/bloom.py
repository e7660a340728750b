"""Blocked Bloom filters of 64-bit hashes: shards of one table of bounded size that is broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longs of 64 bits in a block, bits set in it a key, keys that a block is meant for, and most blocks (64 MB).
BLOCK_LONGS, PROBES, KEYS_PER_BLOCK, MOST_BLOCKS = 8, 6, 32, 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the unsigned value."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class ShardedBloom:
    """Filters of shards 0.. in one table, each with blocks in proportion to its keys.

    A table that MOST_BLOCKS bounds gets fuller than meant: then more hashes pass that aren't keys, but no key is missed.
    """

    def __init__(self, sizes: list[int]):
        share = min(1.0, (MOST_BLOCKS - len(sizes)) / max(1, sum(-(-n // KEYS_PER_BLOCK) for n in sizes)))
        blocks = [max(1, int(-(-n // KEYS_PER_BLOCK) * share)) for n in sizes]
        self.first = np.cumsum([0, *blocks[:-1]]).astype(np.uint64)
        self.blocks = np.array(blocks, np.uint64)
        self.table = np.zeros(sum(blocks) * BLOCK_LONGS, np.uint64)

    def places(self, hashes: np.ndarray, shard: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(block, word whose pieces of nine bits name the bits in it) of unsigned hashes."""
        spread = mixed(hashes)
        block = self.first[shard] + ((spread >> np.uint64(32)) * self.blocks[shard] >> np.uint64(32))
        return block.astype(np.int64), mixed(spread + np.uint64(0x9E3779B97F4A7C15))

    def possible(self, hashes: np.ndarray, shard: np.ndarray | int = 0) -> np.ndarray:
        """Positions of the hashes that may be keys of their shard."""
        block, bits = self.places(hashes, shard)
        left = np.arange(len(hashes))
        for probe in range(PROBES):
            spot = bits >> np.uint64(9 * probe) & np.uint64(511)
            there = (self.table[block * BLOCK_LONGS + (spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
            left, block, bits = left[there], block[there], bits[there]
        return left


def build(keys: DataFrame, shards: int = 1) -> ShardedBloom:
    """The filters of `keys` (h long, shard int). Blocks are OR-ed in Spark; at most MOST_BLOCKS of them reach the driver."""
    sizes = [0] * shards
    for row in keys.groupBy("shard").count().collect():
        sizes[row["shard"]] = row["count"]
    made = ShardedBloom(sizes)
    first, blocks, names = made.first, made.blocks, [f"w{i}" for i in range(BLOCK_LONGS)]

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = ShardedBloom([])
        empty.first, empty.blocks = first, blocks
        for part in parts:
            block, bits = empty.places(part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy())
            words = np.zeros((len(block), BLOCK_LONGS), np.uint64)
            for probe in range(PROBES):
                spot = bits >> np.uint64(9 * probe) & np.uint64(511)
                words[np.arange(len(block)), (spot >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (spot & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(words[:, i].view(np.int64)) for i in range(BLOCK_LONGS))], names=["block", *names])

    placed = keys.select("h", "shard").mapInArrow(place, "block bigint, " + ", ".join(f"{n} bigint" for n in names))
    rows = placed.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toArrow()
    table = made.table.reshape(-1, BLOCK_LONGS)
    for i, name in enumerate(names):
        table[rows["block"].to_numpy(), i] = rows[name].to_numpy().view(np.uint64)
    return made
