"""The corpus pipeline, stage by stage."""

from collections import Counter

from pyspark.sql import functions as F
from test_nearcopies import brute_groups

from duelgrid.llm import pipeline as corpus_pipeline
from duelgrid.llm.decontaminate import find_benchmark
from duelgrid.llm.mixing import mix_sources


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.toPandas()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    known = stages["language_id"](spark, docs, sf)
    assert known.columns == docs.columns and known.count() >= 0.97 * len(before)
    single = stages["near_duplicates"](spark, known, sf)
    kept = {r.doc_id: r.text for r in single.collect()}
    groups = brute_groups([(r.doc_id, r.text) for r in known.collect()])
    assert set(groups.values()) == set(kept)
    assert len(set(kept.values())) == len(kept)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = stages["decontamination"](spark, single, sf)
    leaks = {r.doc_id for r in find_benchmark(single, bench).collect()}
    assert leaks and {r.doc_id for r in clean.collect()} == set(kept) - leaks
    mixed = stages["mixing"](spark, clean, sf)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.select("doc_id").collect()} <= set(kept) - leaks
    placed = stages["sharding"](spark, mixed, sf)
    assert placed.count() == mixed.count() and placed.where("shard not between 0 and 23").count() == 0


def test_run_and_empty(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def _words(docs):
    return {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}


def test_mix_words_meet_targets(spark, table):
    # b is to give 0.83 of its words and c 1.67 times its words: whole copies of each document can't
    docs = table([(i, " ".join(f"w{i}x{j}" for j in range(200 + i % 80)), "en", "abc"[i % 3]) for i in range(3000)]).drop("_id")
    target = {r["source"]: r["target"] for r in mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    given, size = _words(corpus_pipeline.mix(spark, docs, "")), _words(docs)
    assert min(t / size[s] for s, t in target.items()) < 0.9
    for source in "abc":
        # a copy more or less has a standard deviation of at most half a document: four of them over 1,000 documents
        assert abs(given[source] - target[source]) <= 4 * 0.5 * 280 * 1000**0.5 + 64


def test_mix_keeps_rows_without_or_with_shared_ids(spark, table):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(100))
    # one source, so the target is 1.5 times its size: every row has one or two copies, or a few none
    rows = [(None, text(i), "en", "a") for i in range(300)] + [(7, text(i), "en", "a") for i in range(300, 600)] + [(8, text(600), "en", "a")] * 300
    docs = table(rows).drop("_id")
    found = corpus_pipeline.mix(spark, docs.repartition(5), "")
    given = Counter((r["doc_id"], r["text"]) for r in found.collect())
    by_id = Counter()
    for (doc_id, _), times in given.items():
        by_id[doc_id] += times
    # 300 rows each: 450 copies, give or take four standard deviations of the draws and of the blocks
    assert set(by_id) == {None, 7, 8} and all(380 <= n <= 520 for n in by_id.values())
    assert max(n for (i, _), n in given.items() if i != 8) <= 2 and sum(i is None for i, _ in given) > 250
    # neither the partitions nor the order of the rows matter
    again = corpus_pipeline.mix(spark, docs.orderBy(F.desc("text")).coalesce(2), "")
    assert Counter((r["doc_id"], r["text"]) for r in again.collect()) == given


EXTRAS = ["_id", "_times", "_copy", "_text", "_user", "_hash", "_k1", "_row", "score", "lang_pred", "shard", "distance", "_mix_hash"]


def test_stages_keep_clashing_columns_and_odd_rows(spark, sf):
    """Extra columns of any name, null ids, ids given twice, rows given three times, null, empty and very long texts."""
    real = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    long_text = real.first()["text"] + " " + " ".join(f"w{i * i}" for i in range(3_000_000))
    odd = [(None, item, "en", "a"), (None, None, None, None), (7, "", "en", None), (7, long_text, None, "a")]
    more = spark.createDataFrame([(*r, 0) for r in odd], "doc_id long, text string, lang string, source string, n_chars long")
    plain = real.unionByName(more, allowMissingColumns=True).select("doc_id", "text", "lang", "source", "n_chars")
    docs = plain
    for name in EXTRAS:
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        once = Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, sf).select("doc_id", "text").collect())
        whole = stage(spark, docs.unionByName(docs).unionByName(docs), sf)
        assert whole.columns == docs.columns and whole.where("score <> 'x' or _user <> 'x' or _k1 <> 'x'").count() == 0
        thrice = Counter((r["doc_id"], r["text"]) for r in whole.select("doc_id", "text").collect())
        if name == "mixing":
            # copies are drawn, but every row has its own: never the square
            assert set(once) <= set(thrice) and sum(thrice.values()) <= 3 * 2 * docs.count()
        else:
            assert thrice == Counter({k: 3 * n for k, n in once.items()})
        if name == "decontamination":
            assert (None, item) not in once and (7, "") in once and (None, None) in once
    assert corpus_pipeline.shard(spark, docs, sf).count() == docs.count()
