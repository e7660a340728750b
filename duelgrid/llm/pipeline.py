"""The training-data pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), uses the columns doc_id, text, lang and source, and carries all columns of `docs`
in one struct, so that extra columns may have any names. Rows are told apart by what they hold, never by doc_id alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelgrid.llm.decontaminate import find_benchmark
from duelgrid.llm.langid import UNKNOWN, fit_filters, predict_language
from duelgrid.llm.mixing import count_words, mix_sized
from duelgrid.llm.nearcopies import drop_near_duplicates, text_keys
from duelgrid.llm.sharding import assign_shards
from duelgrid.llm.storage import materialize

#: A document is rejected if its language is unknown or it differs from the given one with at least this share.
SURE = 0.5
#: Seed of the draws that round a document's copies.
COPY_SEED = 7_411


def _user(docs: DataFrame) -> Column:
    return F.struct(*(docs[c] for c in docs.columns)).alias("_user")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language that doesn't contradict the given one; a null lang accepts any language.

    Null and empty texts, and texts without a letter, have no known language and go. Repeated rows and null ids are
    judged by their text like others; an empty table gives no rows.
    """
    filters = fit_filters(docs, F.lit(True))
    judged = predict_language(docs, filters, [_user(docs), docs["lang"].alias("_given")])
    agrees = F.col("_given").isNull() | (F.col("_given") == F.col("lang_pred")) | (F.col("score") < SURE)
    return judged.where((F.col("lang_pred") != UNKNOWN) & agrees).select("_user.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays.

    It is the one of the smallest doc_id (nulls last). Rows that repeat an id and a text are one document and share its
    fate; rows that share an id but not the text are different documents; texts without words are one group.
    """
    return drop_near_duplicates(docs, 5, 0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Documents are matched by their whole text, so one without an id goes too, and repeated rows share their fate. Null
    texts hold nothing and stay.
    """
    held = docs.select(_user(docs), *text_keys(docs["text"]), docs["text"].alias("_text"))
    texts = held.select(F.concat_ws(" ", "_k1", "_k2").alias("_doc"), "_text")
    leaks = find_benchmark(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_doc", text_col="_text", short_items=True)
    parts = F.split("_doc", " ")
    leaks = materialize(leaks.select(parts[0].cast("long").alias("_k1"), parts[1].cast("long").alias("_k2")).distinct(), "leaks")
    return held.join(leaks, ["_k1", "_k2"], "left_anti").select("_user.*")


#: Rows that one row of a chunk table expands to at most.
CHUNK = 4096


def content_keys(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all of a row's values; which of them are null counts."""
    nulls = F.concat_ws("", *(F.when(docs[c].isNull(), "1").otherwise("0") for c in docs.columns))
    values = [docs[c] for c in docs.columns]
    return [F.xxhash64(nulls, *values).alias("_h1"), F.xxhash64(F.lit(1), nulls, *values).alias("_h2")]


def _numbered(counts: DataFrame, count: str, number: str) -> DataFrame:
    """Each row `count` times, as 0.. in `number`; large counts are cut into chunks, which are dealt over the tasks."""
    chunks = counts.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {CHUNK}"))))
    few = chunks.where(f"{count} <= {CHUNK}")
    many = chunks.where(f"{count} > {CHUNK}").repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h1", "_chunk")
    upto = F.least((F.col("_chunk") + 1) * CHUNK, F.col(count)) - 1
    return few.unionByName(many).withColumn(number, F.explode(F.sequence(F.col("_chunk") * CHUNK, upto))).drop("_chunk")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: taken / size copies on average.

    A document has floor(taken / size) copies, and one more with the fraction's probability by a seeded hash, so the
    expected copies times its size are the words taken from it. Every row counts as a row of its own: rows with a null
    doc_id are mixed like others, rows that share a doc_id each have copies of their own, and rows that repeat everything
    are mixed one by one and share their copies evenly. Texts without words give no words to take and go. The mix depends
    on the rows' contents alone.
    """
    keyed = docs.select(_user(docs), *content_keys(docs), docs["source"].alias("_source"), count_words(docs["text"]).alias("_size"))
    counts = materialize(keyed.groupBy("_h1", "_h2").agg(F.first("_source").alias("_source"), F.first("_size").alias("_size"), F.count(F.lit(1)).cast("long").alias("_rows")), "contents")
    each = _numbered(counts, "_rows", "_number").select(F.concat_ws("-", "_h1", "_h2", "_number").alias("_id"), "_source", "_size", "_h1", "_h2", "_rows")
    each = materialize(each, "sized")
    more = F.pmod(F.xxhash64("_id", F.lit(COPY_SEED)), F.col("_size")) < F.expr("taken % _size")
    times = F.expr("taken div _size") + more.cast("long")
    taken = mix_sized(each).where("taken > 0").select("_h1", "_h2", "_rows", times.alias("_times"))
    taken = materialize(taken.groupBy("_h1", "_h2", "_rows").agg(F.sum("_times").alias("_times")).where("_times > 0"), "copies")
    rows = keyed.select("_h1", "_h2", "_user")
    once = rows.join(taken.where("_rows = 1"), ["_h1", "_h2"]).select("_h1", "_h2", "_user", "_times")
    # rows that repeat everything are numbered inside the partitions they are written from, so that no task gets them all
    same = rows.join(taken.where("_rows > 1"), ["_h1", "_h2"]).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    same = materialize(same, "repeats")
    inside = F.row_number().over(Window.partitionBy("_h1", "_h2", "_part").orderBy("_at")) - 1
    held = same.groupBy("_h1", "_h2", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_h1", "_h2").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = same.withColumn("_inside", inside).join(held.select("_h1", "_h2", "_part", before.alias("_before")), ["_h1", "_h2", "_part"])
    shared = F.expr("_times div _rows") + (F.col("_inside") + F.col("_before") < F.expr("_times % _rows")).cast("long")
    repeats = placed.select("_h1", "_h2", "_user", shared.alias("_times")).where("_times > 0")
    return once.unionByName(repeats).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_user.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; equal texts share a shard, null texts are one group, repeated rows have slots of their own."""
    return assign_shards(docs, 24)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Learned filters, fingerprints and edit distances have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
