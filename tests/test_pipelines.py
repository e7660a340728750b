"""The analysis steps end to end on synthetic tables with planted effects."""

import pytest
from pyspark.sql import functions as F

from duelgrid.operators import design as D
from duelgrid.operators import quality as Q
from duelgrid.operators import regression as G
from duelgrid.operators.resample import game_folds
from duelgrid.params import Params
from duelgrid.plans import pipelines as P
from duelgrid.sources.honours import honours_table
from duelgrid.sources.synthetic import EFFECTS, synthetic_contests, synthetic_plays
from duelgrid.sources.tables import read_result, write_table

PARAMS = Params(folds=2, tolerance=1e-5)


def test_planted_effects_are_found(spark):
    plays = synthetic_plays(spark)
    train = plays.where("eligible_primary and split = 'train'")
    pool = plays.select("game_id", "week").distinct()
    assert not any(r.violations for r in Q.play_quality(plays, pool).collect())
    cells = G.gramian(D.play_design(train, train, ["game_id", "play_id"]), train.select("game_id", "play_id", F.col("epa").alias("y")), ["game_id", "play_id"], ["game_id"])
    fit = G.fit_plays(cells.groupBy("a", "b").agg(F.sum("value").alias("value")), D.play_levels(train))
    for term in ("N_W", "N_P", "N_S", "B", "E"):
        assert fit.coefficients[term] == pytest.approx(EFFECTS[term], abs=0.035)
    assert fit.weights()["sack"] == 1.0 and 0 < fit.weights()["win"] < fit.weights()["pressure"] < 1


def test_penalty_plays_count_except_in_one_analysis(spark, tmp_path):
    """Plays with an accepted penalty have another win effect: all fits see it but that of `no_penalty`."""
    folder, plays = str(tmp_path), synthetic_plays(spark)
    moved = plays.withColumn("epa", F.col("epa") - F.when(F.col("accepted_penalty"), 3.0 * F.col("N_W")).otherwise(0.0))
    write_table(moved, folder, "plays")
    P.outcome_weights(spark, folder, PARAMS)
    eligible = plays.where("eligible_primary")
    found = {r.kind: r for r in P.epa_sensitivity(spark, folder).collect()}
    assert found["primary"].plays == found["protected"].plays == eligible.where("split = 'train'").count()
    assert found["no_penalty"].plays == eligible.where("split = 'train' and not accepted_penalty").count() < found["primary"].plays
    planted = EFFECTS["N_W"] / EFFECTS["N_S"]
    assert found["no_penalty"].w_win == pytest.approx(planted, abs=0.02) and found["primary"].w_win > planted + 0.08
    assert {r.cls: r.weight for r in read_result(spark, folder, "outcome_weights").collect()}["win"] == pytest.approx(found["primary"].w_win, abs=1e-9)
    assert read_result(spark, folder, "play_validation").first()["unique_test_plays"] == eligible.where("split = 'test'").count()


def test_sack_effect_must_be_negative(spark, tmp_path):
    folder = str(tmp_path)
    write_table(synthetic_plays(spark).withColumn("epa", -F.col("epa")), folder, "plays")
    with pytest.raises(ValueError, match="negative sack"):
        P.outcome_weights(spark, folder, PARAMS)


def test_steps_in_order(spark, tmp_path):
    folder = str(tmp_path)
    contests, plays = synthetic_contests(spark, 12, 40), synthetic_plays(spark, 12, 40)
    pool = contests.select("game_id", "week").unionByName(plays.select("game_id", "week")).groupBy("game_id").agg(F.max("week").alias("week"))
    plays = plays.drop("week", "split").join(pool, "game_id").withColumn("split", F.when(F.col("week") <= 15, "train").otherwise("test"))
    contests = contests.drop("week").join(pool, "game_id")
    with pytest.raises(FileNotFoundError, match="earlier"):
        P.outcome_weights(spark, folder, PARAMS)
    P.data_engineering(spark, folder, contests, plays, pool, game_folds(contests, 2, 1), PARAMS)
    P.outcome_weights(spark, folder, PARAMS)
    P.player_models(spark, folder, [0.1, 0.05], PARAMS)
    P.validation(spark, folder, PARAMS)
    assert read_result(spark, folder, "validation").count() == 4
    assert abs(read_result(spark, folder, "holdout_predictions").groupBy("model", "play_id").agg(F.sum("p").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]) < 1e-9
    P.rankings(spark, folder, honours_table(spark), PARAMS)
    assert read_result(spark, folder, "rankings").where("method = 'bt' and min_interactions = 0").count() > 0
    P.bootstrap(spark, folder, [0.1, 0.05], [1, 2], PARAMS)
    spread = read_result(spark, folder, "rank_uncertainty")
    assert spread.count() > 0 and spread.where("rank_q025 > rank_q975 or n_draws <> 2").count() == 0
    # every replicate has weights of its own, learnt on its games
    weights = {(r.replicate_id, r.cls): r.weight for r in read_result(spark, folder, "ratings_weights").collect()}
    assert weights[1, "sack"] == weights[2, "sack"] == 1.0 and weights[1, "win"] != weights[2, "win"]
    assert read_result(spark, folder, "ratings_bootstrap_diagnostics").count() == 4
    P.bootstrap(spark, folder, [0.1], [1, 2], PARAMS, "validation")
    assert read_result(spark, folder, "validation_uncertainty").where("improvement_q025 <= improvement_q975").count() == 4
    # losses of the refitted models differ from draw to draw
    assert read_result(spark, folder, "validation_draw_losses").where("model = 'win'").select("model_loss").distinct().count() == 2
    with pytest.raises(ValueError, match="fresh"):
        P.bootstrap(spark, folder, [0.2], [1, 2], PARAMS, "validation")
    P.sensitivity(spark, folder, [0.1, 0.03], PARAMS)
    assert read_result(spark, folder, "baseline_selected").count() == 2 and read_result(spark, folder, "epa_sensitivity").count() == 3
    assert read_result(spark, folder, "baseline_model_cv").count() == 4 and read_result(spark, folder, "ordinal_cv_comparison").count() == 2
    P.weekly(spark, folder, [4, 18], PARAMS)
    assert read_result(spark, folder, "weekly_point_diagnostics").where("status in ('complete', 'season')").count() == 4
    season = read_result(spark, folder, "all_rankings").where("min_interactions = 0 and comparison_id in ('bt:standardized_probability', 'bt:expected_severity')").select("model", "role", "player_key", F.col("score").alias("season"))
    last = read_result(spark, folder, "weekly_scores").where("week = 18").join(season, ["model", "role", "player_key"])
    assert last.count() > 0 and last.agg(F.max(F.abs(F.col("score") - F.col("season")))).first()[0] < 1e-12
    P.weekly_uncertainty(spark, folder, [4, 18], [1, 2], PARAMS)
    assert read_result(spark, folder, "weekly_uncertainty").where("interval_status = 'complete' and lower <= upper").count() > 0
    P.plot_tables(spark, folder)
    assert all(read_result(spark, folder, f"plot_{n}").count() > 0 for n in ("cv_curves", "calibration", "weekly"))
    P.tuned_validation(spark, folder, [1, 2], PARAMS)
    assert read_result(spark, folder, "tuned_baseline_validation_summary").where("n_boot = 2").count() == 26
