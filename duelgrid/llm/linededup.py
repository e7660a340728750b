"""Exact line deduplication across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.storage import materialize

#: White space of the line rule: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; pure ASCII text takes Spark's faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key is found in at least `min_docs` documents, except in the smallest id that holds the key.

    A key is the line without BLANKS at its ends, A-Z lower-cased; keys under `min_chars` code points always stay.
    Returns the id, n_lines, n_dropped and kept_text (kept lines joined by a newline). A null or empty text is one
    empty line. A document is an id: it counts once for each key, however often the key repeats inside or in rows that
    repeat the id; these rows are each returned. An empty table gives no rows; other columns are not read. Keys are compared by two 64-bit hashes (128 bits), and only hashes and positions are
    shuffled until the text meets its dropped positions. A null id is smaller than all others.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # the row's own key, so that repeated ids stay apart where that matters: equal (id, text) rows lose the same lines
    rows = rows.withColumn("_row", F.xxhash64(F.lit(11), "_text"))
    lines = rows.select("_id", "_row", F.posexplode(F.split(lower_ascii(F.col("_text")), "\n")).alias("_at", "_line"))
    lines = lines.select("_id", "_row", "_at", F.btrim("_line", F.lit(BLANKS)).alias("_key")).where(F.length("_key") >= min_chars)
    lines = lines.select("_id", "_row", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    # a document counts once for each key: distinct ids first, with partial sums, then their number
    holders = lines.groupBy("_h1", "_h2", "_id").agg(F.count(F.lit(1)).alias("_times"))
    counted = holders.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"), F.min("_id").alias("_low"), F.count_if(F.col("_id").isNull()).alias("_nulls"))
    shared = counted.where(F.col("_docs") >= min_docs)
    # written, so that the join is between plain shuffles and the partition of a very common line can be split
    shared = materialize(shared.select("_h1", "_h2", F.when(F.col("_nulls") == 0, F.col("_low")).alias("_keeper")), "shared-lines")
    dropped = lines.join(shared, ["_h1", "_h2"]).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    dropped = dropped.groupBy("_id", "_row").agg(F.collect_set("_at").alias("_ats")).select(F.col("_id").alias("_did"), F.col("_row").alias("_drow"), "_ats")
    whole = rows.select("_id", "_row", F.split("_text", "\n").alias("_lines"))
    met = whole.join(dropped, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_row") == F.col("_drow")), "left")
    gone = F.coalesce(F.col("_ats"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    kept = F.when(F.size(gone) == 0, F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda at: F.element_at(F.col("_lines"), at + 1)), "\n"))
    return met.select(
        F.col("_id").alias(id_col),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
