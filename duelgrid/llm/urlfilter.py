"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.storage import materialize

#: Longs of 64 bits in a block, bits set in it a key, and most blocks (64 MB of filter, whatever the list's size).
BLOCK_LONGS, PROBES, MAX_BLOCKS = 8, 6, 1 << 20
KEYS_PER_BLOCK = 32


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """host/path without www., a default port, slashes or .html at the end: one key for spellings of one page."""
    return F.concat(F.regexp_replace(host, r"^www\.|:(80|443)$", ""), F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", ""))


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, [key, long] words to set): PROBES bits in one block of BLOCK_LONGS longs."""
    mixed = hashes.astype(np.int64).view(np.uint64)
    block = ((mixed >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
    words = np.zeros((len(mixed), BLOCK_LONGS), np.uint64)
    at = np.arange(len(mixed))
    for probe in range(PROBES):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(probe + 1)
        spot = mixed >> np.uint64(55)
        np.bitwise_or.at(words, (at, (spot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (spot & np.uint64(63)))
    return block, words


def build_filter(keys: DataFrame) -> np.ndarray:
    """[block, long] of all `key` strings: blocks are OR-ed in Spark, and at most MAX_BLOCKS of them reach the driver.

    The number of blocks follows the list up to that bound; a longer list makes the filter fuller, never wrong.
    """
    blocks = int(min(MAX_BLOCKS, max(1, -(-keys.count() // KEYS_PER_BLOCK))))
    names = [f"w{i}" for i in range(BLOCK_LONGS)]

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            block, words = _bits(part.column(0).to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(words[:, i].view(np.int64)) for i in range(BLOCK_LONGS))], names=["block", *names])

    placed = keys.select(F.xxhash64("key").alias("_h")).mapInArrow(place, "block bigint, " + ", ".join(f"{n} bigint" for n in names))
    rows = placed.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toArrow()
    table = np.zeros((blocks, BLOCK_LONGS), np.uint64)
    for i, name in enumerate(names):
        table[rows["block"].to_numpy(), i] = rows[name].to_numpy().view(np.uint64)
    return table


def flag_possible(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """`rows` (which has `key`) with `_maybe`: false only if the key isn't in `keys`. Nothing is shuffled."""
    held = rows.sparkSession.sparkContext.broadcast(build_filter(keys))

    def test(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for part in parts:
            block, words = _bits(part.column(part.num_columns - 1).to_numpy(), len(table))
            hit = ((table[block] & words) == words).all(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hit)], names=[*part.schema.names[:-1], "_maybe"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _maybe boolean"
    return rows.withColumn("_h", F.xxhash64("key")).mapInArrow(test, schema)


def match_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones the one later in order wins."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0]), reverse=True)
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    `rules` are (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's;
    the longest one wins and decides. Otherwise a page is blocked if its canonical URL is in `blocked` (a `key` column;
    repeats and nulls are ignored), else allowed. The few rules are tested in each row. The list may have any size: rows
    go through its Bloom filter where they are read; only rows that pass are shuffled, and an exact hash join of their
    distinct keys with the list removes false positives. The keys found are written, so that the rows of one very
    common URL can be dealt over several tasks when they meet it.

    A url that is null or has no :// has an empty host and path and is allowed. Repeated rows are each returned. Other
    columns are not read; an empty table gives no rows.
    """
    shown = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keys = blocked.where(F.col("key").isNotNull()).select("key").distinct()
    tested = flag_possible(shown.withColumn("key", canonical(F.col("host"), F.col("path"))), keys)
    tested = materialize(tested.withColumn("_maybe", F.col("_maybe") & (F.col("host") != "")), "urls")
    found = tested.where("_maybe").select("key").distinct().join(keys.hint("shuffle_hash"), "key")
    found = materialize(found.withColumn("_listed", F.lit(True)), "listed")
    passed = tested.where("_maybe").join(found, "key", "left").select("_id", "host", "path", "_listed")
    rest = tested.where("not _maybe").select("_id", "host", "path", F.lit(None).cast("boolean").alias("_listed"))
    judged = rest.unionByName(passed).withColumn("_rule", match_rule(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed"), F.lit("block")), F.lit("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
