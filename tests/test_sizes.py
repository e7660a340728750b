"""Rules and task sizes that only larger tables break."""

import pytest
from pyspark.sql import functions as F

from duelgrid.operators import baselines as B
from duelgrid.operators import contests as C
from duelgrid.operators import quality as Q
from duelgrid.operators.ridge import vectors
from duelgrid.operators.scoring import opponent_sums
from duelgrid.plans import queries
from duelgrid.sources import adapter as A


def test_many_equal_weights_add_up(spark):
    n = 9_800_133
    weights = spark.range(0, n, 1, 1).select(F.lit("win").alias("model"), F.lit(1.0 / n).alias("weight"))
    assert {r.rule: r.violations for r in Q.reference_quality(weights, ["model"]).collect()} == {"R01_positive": 0, "R02_sum": 0}
    odd = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 1e300), ("c", 0.5), ("c", 0.5)], "model string, weight double")
    assert {r.rule: r.violations for r in Q.reference_quality(odd, ["model"]).collect()} == {"R01_positive": 1, "R02_sum": 2}


@pytest.mark.parametrize("role", ["Rusher", "Blocker"])
def test_contexts_follow_the_contests_in_number_of_tasks(spark, sf, monkeypatch, role):
    contests = A.contests(spark, sf)
    wanted = {tuple(r) for r in C.reference_contexts(contests, role).select("model", "opponents", F.round("weight", 12)).collect()}
    monkeypatch.setattr(C, "TASK_CONTESTS", 100)
    found = C.reference_contexts(contests, role)
    assert found.rdd.getNumPartitions() >= contests.count() // 100
    assert {tuple(r) for r in found.select("model", "opponents", F.round("weight", 12)).collect()} == wanted


def test_gramians_shuffle_sums_not_plays(spark, sf):
    plan = queries._game_gramian(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_losses_of_many_jobs_equal_those_of_one(spark, sf, monkeypatch):
    contests, folds = A.contests(spark, sf), A.folds(spark, sf)
    key = lambda df: {(r["fold"], r["model"], r["strength"]): (round(r["loss"], 12), r["test_rows"], r["test_games"]) for r in df.collect()}
    found = B.fold_losses(contests, folds)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    wanted = key(found)
    monkeypatch.setattr(B, "PROFILE_NUMBERS", 1)
    monkeypatch.setattr(B, "STEP_ROWS", 1)
    assert key(B.fold_losses(contests, folds)) == wanted


def test_contexts_add_up_opponents_inside_the_row(spark):
    contexts = spark.createDataFrame([(1, "a|b|x"), (2, "")], "id int, opponents string")
    table = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [10.0, 20.0])], "blocker_key string, blocker_key_beta array<double>")
    assert sorted(map(tuple, opponent_sums(contexts, table, 2).collect())) == [(1, "a|b|x", 2, 11.0, 22.0), (2, "", 0, 0.0, 0.0)]


def test_design_rows_follow_the_contests_in_number_of_tasks(spark, sf, monkeypatch):
    contests = A.contests(spark, sf)
    monkeypatch.setattr(C, "TASK_CONTESTS", 100)
    rows, terms, _ = vectors(contests, "severity")
    assert rows.rdd.getNumPartitions() >= contests.count() // 100
    assert rows.agg(F.sum("weight")).first()[0] == C.model_sample(contests, "severity").count() and terms


def test_cohorts_read_contests_once(spark, sf):
    plan = queries._ranked(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "score" in plan and "blocker_keys" not in plan and "rusher_key" not in plan


def test_profiles_explode_opponents_alone(spark, sf):
    plan = C.outcome_profiles(A.contests(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(blocker_keys") == 1 and "lambda" not in plan


def test_masses_equal_those_of_participations(spark, sf):
    contests = A.contests(spark, sf)
    none = F.array().cast("array<string>")
    odd = contests.withColumn("blocker_keys", F.when(F.col("play_id") % 7 == 0, none).when(F.col("play_id") % 11 != 0, F.col("blocker_keys")))
    odd = odd.withColumn("rusher_key", F.when(F.col("play_id") % 5 != 0, F.col("rusher_key")))
    key = ["model", "role", "player_key", "cls"]
    rows = lambda df: {tuple(r[k] for k in key): (round(r["mass"], 9), r["interactions"]) for r in df.collect()}
    for table in (contests, odd):
        wanted = rows(C.participations(C.observations(table)).groupBy(*key).agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("interactions")))
        assert wanted and rows(C.class_masses(C.observations(table), [])) == wanted and rows(C.season_masses(table)) == wanted
        shown = {tuple(r[k] for k in key): (round(r["mass"], 9), round(r["total"], 9), r["interactions"]) for r in C.outcome_profiles(table).collect()}
        for (model, role, player, cls), (mass, total, seen) in shown.items():
            held = {c: v for (m, o, p, c), v in wanted.items() if (m, o, p) == (model, role, player)}
            assert mass == (0 if player is None else held.get(cls, (0.0, 0))[0])
            assert abs(total - sum(v for v, _ in held.values())) < 1e-6 and seen == sum(n for _, n in held.values())


def test_members_are_sorted_without_a_function(spark, sf, tmp_path):
    plan = A._order_lines(spark, sf, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    rows = [(1, s, "N", 30.0) for s in (9, 10, 1, 61, None, -3)] + [(2, 7, "R", 50.0), (2, 67, "A", 45.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r["order"]: r for r in A._order_lines(spark, str(tmp_path), 2).collect()}
    assert [tuple(m) for m in found[1].members] == [(None, None, "win"), ("s-3", 0, "win"), ("s1", 0, "win"), ("s10", 1, "win"), ("s9", 0, "win")]
    assert [tuple(m) for m in found[2].members] == [("s7", 0, "sack")] and (found[2].lines, found[2].sacks, found[2].pressures) == (2, 1, 1)
