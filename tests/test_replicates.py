"""Replicates as lanes against fits of rows that are really repeated, and draws that have no score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.operators import contests as C
from duelgrid.operators import draws as W
from duelgrid.operators import lanes as L
from duelgrid.operators import replicates as N
from duelgrid.operators import resample as S
from duelgrid.operators import weekly as K
from duelgrid.operators.ridge import best_penalty, centred_tables, cross_validate
from duelgrid.operators.scoring import lane_outcomes, lane_score_types, standardized_scores
from duelgrid.params import CLASSES
from duelgrid.sources import adapter as A

WEIGHTS = (0.0, 0.25, 0.5, 1.0)


@pytest.fixture(scope="module")
def contests(spark, sf):
    return A.contests(spark, sf).cache()


@pytest.fixture(scope="module")
def drawn(spark, sf):
    return S.bootstrap_draws(A.game_pool(spark, sf), 3, 5, "ratings").cache()


def repeated(contests, drawn, number, week):
    rows = contests.where(F.col("week") <= week).join(drawn.where(F.col("replicate_id") == number).select("game_id", "copies"), "game_id")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


@pytest.mark.parametrize("model", ["win", "severity"])
def test_lanes_are_fits_of_repeated_rows(contests, drawn, model):
    games = N.games_of(contests, drawn, [1, 2, 3])
    packed, pairs = games.packed(contests, model), [(1, 9), (2, 18), (3, 12)]
    copies = np.stack([games.copies[i] * (games.weeks <= w) for i, w in pairs])
    theta, gradient, states = N.fit_lanes(packed, np.full(3, 0.05), copies, tolerance=1e-10)
    assert states == ["complete"] * 3 and gradient.max() < 1e-10
    tables = centred_tables(packed.terms, model, theta)
    for at, (number, week) in enumerate(pairs):
        rows = repeated(contests, drawn, number, week)
        one = L.pack(rows, model)
        alone, _, _, _ = L.minimise(one.rows.cache(), model, len(one.terms), np.array([0.05]), np.array([-1]), tolerance=1e-10)
        place = [packed.terms.index(t) for t in one.terms]
        whole = np.zeros((1, L.head_count(model), len(packed.terms) + 1))
        held = alone.reshape(1, L.head_count(model), -1)
        whole[:, :, place], whole[:, :, -1] = held[:, :, :-1], held[:, :, -1]
        assert np.abs(centred_tables(packed.terms, model, whole.reshape(1, -1))[0] - tables[at]).max() < 1e-8


def test_penalties_are_chosen_by_each_replicate(spark, sf, contests, drawn):
    """A replicate's losses by fold and penalty are those of its own rows, whose copies stay in their fold."""
    folds, penalties = A.folds(spark, sf), [0.3, 0.03]
    games = N.games_of(contests, drawn, [1, 2], folds)
    packed = games.packed(contests, "win")
    use = games.weeks <= 15
    curves, _ = N.choose_penalties(packed, games, [1, 2], penalties, use)
    rows = repeated(contests, drawn, 2, 15).join(folds, "game_id")
    alone = L.pack(rows, "win")
    curve, _ = cross_validate(L.Packed(alone.rows.cache(), alone.terms, "win"), penalties, 5)
    for (p, loss, se), (q, loss_, se_) in zip(curves[2], curve):
        assert p == q and loss == pytest.approx(loss_, abs=1e-7) and se == pytest.approx(se_, abs=1e-6)
    theta, _, states, chosen, edge = N.replicate_fits(packed, games, [1, 2], penalties, use)
    assert states == ["complete"] * 2 and chosen == [best_penalty(curves[i]) for i in (1, 2)] and edge == [True, True]
    told = N.replicate_losses(packed, games, [1, 2], theta, ~use, 1e-15)
    later = drawn.where("replicate_id = 2").join(contests.where("week > 15"), "game_id")
    assert told[1, 0] == C.model_sample(later, "win").agg(F.sum("copies")).first()[0]


def test_score_types_of_lanes(spark, contests):
    """Scores of a lane are the standardised ones under its own weights; without weights the severity scores are null."""
    rows = contests.where("week <= 5")
    packed = L.pack(rows, "severity")
    theta = np.random.default_rng(1).normal(size=(3, L.parameter_count("severity", len(packed.terms)))) / 3
    tables = centred_tables(packed.terms, "severity", theta)
    settings = spark.createDataFrame([(0, list(WEIGHTS), 0.5), (1, [0.0, 0.1, 0.9, 1.0], 0.25), (2, [0.0, float("nan"), 0.5, 1.0], 0.5)], "lane int, weights array<double>, share double")
    for role in ("Rusher", "Blocker"):
        found = lane_score_types(lane_outcomes(rows, "severity", role, packed.terms, tables, [0, 1, 2]), "severity", role, settings).cache()
        for lane, weights, share in ((0, WEIGHTS, 0.5), (1, (0.0, 0.1, 0.9, 1.0), 0.25)):
            long = [("severity", t, c, float(v)) for c, values in zip(CLASSES, tables[lane]) for t, v in zip([*packed.terms, "(Intercept)"], values)]
            beta = spark.createDataFrame(long, "model string, term string, cls string, coefficient double")
            wanted = {r.player_key: r for r in standardized_scores(rows, beta, "severity", role, weights, share, credits=True).collect()}
            for kind, column in (("coefficient", "coefficient"), ("expected_severity", "score"), ("credited_coefficient", "credited_coefficient"), ("expected_credited_severity", "credited_score")):
                ours = {r.player_key: r.score for r in found.where((F.col("lane") == lane) & (F.col("score_type") == kind)).collect()}
                assert ours.keys() == wanted.keys() and all(v == pytest.approx(wanted[k][column], abs=1e-9) for k, v in ours.items())
        assert found.where("lane = 2").count() == found.where("lane = 1").count() and found.where("lane = 2 and score is not null").count() == 0


def test_an_undefined_draw_stays_and_is_told(spark, contests, drawn):
    """A replicate without weights keeps its rows: intervals of severity scores say that a draw is missing, win ones don't."""
    games = N.games_of(contests, drawn, [1, 2, 3])
    nan, parts, told = float("nan"), [], {}
    weights = {1: WEIGHTS, 2: (0.0, nan, nan, nan), 3: WEIGHTS}
    for model in ("win", "severity"):
        packed = games.packed(contests, model)
        scores, states = N.weekly_lanes(contests, packed, games, [1, 2, 3], [6, 17], {i: 0.1 for i in (1, 2, 3)}, weights)
        parts.append(scores)
        told |= {(i, w, m): s for i, w, m, s, _ in states}
        theta, _, _ = N.fit_lanes(packed, np.full(3, 0.1), np.stack([games.copies[i] for i in (1, 2, 3)]))
        settings = spark.createDataFrame([(i, list(map(float, weights[i])), 0.5) for i in (1, 2, 3)], "lane int, weights array<double>, share double")
        rated = N.replicate_scores(contests, packed, theta, [1, 2, 3], settings).withColumnRenamed("lane", "replicate_id").withColumn("present_in_draw", F.lit(True))
        shares = {r.defined_fraction for r in W.rating_intervals(rated).where("score_type like 'expected%' or score_type = 'standardized_probability'").collect()}
        assert all(s == pytest.approx(1 if model == "win" else 2 / 3) for s in shares)
    assert {k for k, s in told.items() if s != "complete"} == {(2, 6, "severity"), (2, 17, "severity")}
    values = parts[0].unionByName(parts[1])
    known = K.weekly_availability(contests, drawn).where("week in (6, 17)")
    summary = K.weekly_summary(contests, drawn, values, known, 3).cache()
    assert summary.count() == known.where("replicate_id = 1").count()
    assert summary.where("model = 'win' and (interval_status <> 'complete' or lower > upper or defined_draws <> 3)").count() == 0
    assert summary.where("model = 'severity' and (lower is not null or defined_draws <> 2 or conditional_lower is null)").count() == 0
    rates = {(r.replicate_id, r.role, r.player_key): r.raw_score for r in K.weekly_raw_draws(contests, drawn).where("week = 6").collect()}
    alone = K.weekly_raw(repeated(contests, drawn, 3, 6)).where("week = 6").collect()
    assert all(rates[3, r.role, r.player_key] == pytest.approx(r.raw_score) for r in alone) and len(alone) > 50
    assert summary.where("model = 'win' and absent_draws > 0 and raw_lower is not null").count() == 0 and summary.where("raw_lower <= raw_upper").count() > 0
