"""Ranks, credits, AUC, quantiles and scalar functions against hand-made values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.functions.scalars import name_key, ordinal_probabilities, softmax
from duelgrid.functions.stats import auc, average_rank, guarded_correlation, guarded_percentile, top_credit
from duelgrid.sources.tables import truth


def test_average_rank_and_top_credit(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 3.0), ("d", 3.0), ("e", 1.0), ("f", None)], "k string, s double").withColumn("g", F.lit(1))
    found = {r.k: (r.rank, r.credit) for r in rows.select("k", average_rank(F.col("s"), ["g"]).alias("rank"), top_credit(F.col("s"), ["g"], 2).alias("credit")).collect()}
    assert found["a"] == (1.0, 1.0)
    assert found["b"][0] == 3.0 and found["b"][1] == pytest.approx(1 / 3)
    assert found["e"] == (5.0, 0.0)
    assert found["f"] == (None, None)


def test_top_credit_sums_to_k_or_all(spark):
    rows = spark.createDataFrame([(float(i % 7),) for i in range(30)], "s double").withColumn("g", F.lit(1))
    assert rows.select(top_credit(F.col("s"), ["g"], 10).alias("c")).agg(F.sum("c")).first()[0] == pytest.approx(10)
    assert rows.limit(4).select(top_credit(F.col("s"), ["g"], 10).alias("c")).agg(F.sum("c")).first()[0] == pytest.approx(4)


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(3)
    data = [(bool(y), float(s)) for y, s in zip(rng.integers(0, 2, 40), rng.integers(0, 6, 40))]
    rows = spark.createDataFrame(data, "y boolean, s double").withColumn("g", F.lit(1))
    found = rows.withColumn("r", average_rank(F.col("s"), ["g"], True)).agg(auc(F.col("y"), F.col("r"))).first()[0]
    pairs = [(a > b) + (a == b) / 2 for ya, a in data if ya for yb, b in data if not yb]
    assert found == pytest.approx(sum(pairs) / len(pairs))
    assert rows.where("y").withColumn("r", average_rank(F.col("s"), ["g"], True)).agg(auc(F.col("y"), F.col("r"))).first()[0] is None


def test_guards(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (4.0, 1.0)], "a double, b double")
    got = rows.agg(guarded_percentile(F.col("a"), 0.5), guarded_correlation(F.col("a"), F.col("b")), guarded_correlation(F.col("a"), F.col("a"))).first()
    assert got[0] == 2.0 and got[1] is None and got[2] == pytest.approx(1.0)
    assert rows.unionAll(spark.createDataFrame([(math.nan, 1.0)], rows.schema)).agg(guarded_percentile(F.col("a"), 0.5)).first()[0] is None


def test_softmax_and_ordinal_probabilities(spark):
    rows = spark.createDataFrame([(-800.0,), (0.3,), (800.0,)], "e double")
    cuts = [0.0, 1.2, 2.2]
    for row in rows.select("e", *(p.alias(f"p{i}") for i, p in enumerate(ordinal_probabilities(F.col("e"), cuts)))).collect():
        below = [1 / (1 + math.exp(min(700.0, row.e - c))) for c in cuts]
        assert sum(row[1:]) == pytest.approx(1)
        assert list(row[1:]) == pytest.approx(list(np.diff([0.0, *below, 1.0])), abs=1e-9)
    shares = rows.select(*(p.alias(f"p{i}") for i, p in enumerate(softmax([F.col("e"), F.lit(0.0)])))).collect()
    assert [round(r.p0 + r.p1, 9) for r in shares] == [1.0, 1.0, 1.0]


def test_names_and_truth(spark):
    rows = spark.createDataFrame([("  De'Vondre   O.Campbell ",)], "n string")
    assert rows.select(name_key(F.col("n"))).first()[0] == "devondre ocampbell"
    flags = spark.createDataFrame([("TRUE",), ("0",), ("yes",), (None,)], "t string")
    assert [r[0] for r in flags.select(truth(F.col("t"))).collect()] == [True, False, None, None]
