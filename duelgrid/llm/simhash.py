"""SimHash near-duplicates found through the anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.components import connected_components
from duelgrid.llm.simhash_bits import fingerprint
from duelgrid.llm.storage import materialize

#: Part of a window that the perfect Hamming code of that length covers; its covering radius is 1.
CODE, RADIUS = 31, 1
#: Bits that two fingerprints of one window may differ in.
THRESHOLD = 1
MOST_BITS = 3


def window_parts(max_bits: int) -> list[list[tuple[int, int]]]:
    """For each window, its (first bit, bits) blocks: fingerprints within `max_bits` differ in at most one bit of one window.

    The 64 bits are cut into max_bits + 1 blocks and a window is any two of them. Of up to max_bits differing bits, the
    max_bits - 1 other blocks can be chosen to hold all but one. For up to one bit the window is the whole fingerprint.
    """
    if max_bits < 2:
        return [[(0, 64)]]
    cuts = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [list(pair) for pair in combinations(blocks, 2)]


def window_of(marks: np.ndarray, blocks: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """(the window's bits as one word, their number)."""
    word, at = np.zeros(len(marks), np.uint64), 0
    for start, bits in blocks:
        word |= ((marks.view(np.uint64) >> np.uint64(start)) & np.uint64((1 << bits) - 1)) << np.uint64(at)
        at += bits
    return word, at


def syndromes(part: np.ndarray) -> np.ndarray:
    """XOR of the positions (1..31) of the set bits; 0 for a code word, else the position whose flip gives one."""
    found = np.zeros(len(part), np.int64)
    for bit in range(CODE):
        found ^= ((part >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * (bit + 1)
    return found


def covering_words(word: np.ndarray, bits: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word): the code words at hand for each word of `bits` bits.

    The code is a product: as many Hamming codes of CODE bits as the word has room for, and single bits. With `reach`
    RADIUS only the nearest code word (the home) is given, with RADIUS + THRESHOLD also the homes of all words that
    differ in one bit.
    """
    one, parts = np.uint64(1), bits // CODE
    at, home, wrongs = np.arange(len(word)), word.copy(), []
    for part in range(parts):
        wrong = syndromes((word >> np.uint64(CODE * part)) & np.uint64((1 << CODE) - 1))
        wrongs.append(wrong)
        home ^= np.where(wrong > 0, one << (np.maximum(wrong - 1, 0) + CODE * part).astype(np.uint64), np.uint64(0))
    rows, words = [at], [home]
    if reach > RADIUS:
        for part, wrong in enumerate(wrongs):
            # code words at distance 2 of this part: flip a pair of bits whose positions XOR to the syndrome
            fix = one << (np.maximum(wrong - 1, 0) + CODE * part).astype(np.uint64)
            for first in range(1, CODE + 1):
                second = wrong ^ first
                use = (wrong > 0) & (second > first)
                rows.append(at[use])
                flips = (one << np.uint64(first - 1 + CODE * part)) ^ (one << (second[use] - 1 + CODE * part).astype(np.uint64))
                words.append(home[use] ^ fix[use] ^ flips)
        for bit in range(CODE * parts, bits):
            rows.append(at)
            words.append(home ^ (one << np.uint64(bit)))
    return np.concatenate(rows), np.concatenate(words)


def anchors(marks: np.ndarray, max_bits: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the anchors of each fingerprint in every window; an anchor is a hash of window number and code word."""
    rows, keys = [], []
    for number, blocks in enumerate(window_parts(max_bits)):
        at, words = covering_words(*window_of(marks, blocks), reach)
        mixed = (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        rows.append(at)
        keys.append((mixed ^ (mixed >> np.uint64(32))).view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def add_fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, fp): the 64-bit fingerprint of every whole text; null and empty texts have fingerprint 0, rows may repeat."""
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, fp bigint"

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = np.fromiter((fingerprint(t.as_py(), width) for t in part.column(1)), np.int64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks)], names=["_id", "fp"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(work, schema)


def _anchor_rows(marks: DataFrame, max_bits: int, reach: int, name: str) -> DataFrame:
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                values = part.column(0).slice(at, 4096).to_numpy()
                rows, keys = anchors(values, max_bits, reach)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], names=["anchor", name])

    return marks.mapInArrow(work, f"anchor bigint, {name} bigint")


def near_pairs(marks: DataFrame, max_bits: int) -> DataFrame:
    """(u, v), u < v: every pair of distinct fingerprints (`fp`) that differ in at most `max_bits` (up to 3) bits.

    Two of them differ in at most one bit of some window (`window_parts`). The code word nearest to u's window is within
    the covering radius 1 of it, hence within 1 + 1 of v's window. Each fingerprint is sent to its home anchors (one a
    window) and to every anchor within radius plus one; homes meet replicas by anchor and are compared.

    At 2 bits a window has 42 or 43 bits and 2^37 or 2^38 anchors, and a fingerprint sends at most 28 replicas to each
    of 3 windows: among n fingerprints an anchor with a home holds about 28 n / 2^37 unrelated replicas, 2 at 10 billion.
    A fingerprint has at most 2,080 others within 2 bits, so results stay linear in the input.
    """
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"max_bits must be 0 to {MOST_BITS}")
    homes = _anchor_rows(marks, max_bits, RADIUS, "u")
    replicas = _anchor_rows(marks, max_bits, RADIUS + THRESHOLD, "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    # Spark takes the replicas to be as few as the fingerprints, which are 87 times fewer, and would broadcast them
    return homes.join(replicas.hint("merge"), "anchor").where((F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def near_duplicate_components(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component (smallest id reachable over links of at most `max_bits` differing bits) of every row.

    Rows of equal fingerprint form a class and are joined through it, so copies are never paired with one another;
    only distinct fingerprints go to the anchors. A text without words (null, empty, white space) has fingerprint 0 and
    is linked like any other. Repeated rows are each returned. Null ids never become a component's id unless all its
    ids are null. Other columns are not read; an empty table gives no rows.
    """
    marked = materialize(add_fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("_id").alias("_least")), "classes")
    roots = connected_components(near_pairs(classes.select("fp"), max_bits))
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    merged = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(merged, "_root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")
