"""Queries that take every replicate of the settings, against the same steps with few replicates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.operators import baselines as B
from duelgrid.operators import contests as C
from duelgrid.operators import draws as W
from duelgrid.operators import lanes as L
from duelgrid.operators import resample as S
from duelgrid.params import Params
from duelgrid.plans import queries
from duelgrid.sources import adapter as A


def test_weights_check_takes_every_replicate(spark, sf):
    found = queries.bootstrap_weights_check(spark, sf).collect()
    assert sorted(r.replicate_id for r in found) == list(range(1, Params().draws + 1))
    assert all(r.terms > 15 and r.residual == 0 for r in found)


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["bootstrap_baseline_summary", "tuned_baseline_table"])
def test_tuned_baselines_take_every_replicate(spark, sf, monkeypatch, name):
    def asked(pool, draws, *rest):
        raise Asked(draws)

    monkeypatch.setattr(queries.S, "bootstrap_draws", asked)
    with pytest.raises(Asked) as count:
        getattr(queries, name)(spark, sf)
    assert count.value.args == (Params().draws,)


def test_losses_of_replicates_are_those_of_repeated_rows(spark, sf, monkeypatch):
    """Rows that are weighed by their game's copies have the losses of rows that are joined to the draws, in many jobs too."""
    contests, folds = A.contests(spark, sf), A.folds(spark, sf)
    odd = contests.withColumn("rusher_key", F.when(F.col("play_id") % 5 != 0, F.col("rusher_key")))
    odd = odd.withColumn("blocker_keys", F.when(F.col("play_id") % 11 != 0, F.col("blocker_keys")))
    draws = S.bootstrap_draws(A.game_pool(spark, sf), 3, 7).cache()
    key = lambda df: {(r["replicate_id"], r["fold"], r["model"], r["strength"]): (round(r["loss"], 9), r["test_rows"], r["test_games"]) for r in df.collect()}

    def repeated(test, draws, keys, strengths, masses, shares):
        met = test.join(draws.select("replicate_id", "game_id", "copies"), "game_id")
        return B.losses(test, met, ["replicate_id", *keys], strengths, masses, shares)

    for rows in (contests, odd):
        found = key(W.draw_cv_losses(rows, draws, folds))
        with monkeypatch.context() as m:
            m.setattr(W, "draw_losses", repeated)
            assert key(W.draw_cv_losses(rows, draws, folds)) == found and len(found) == 3 * 5 * 2 * 12
    monkeypatch.setattr(B, "PROFILE_NUMBERS", 1)
    monkeypatch.setattr(B, "STEP_ROWS", 1)
    assert key(W.draw_cv_losses(odd, draws, folds)) == found


def test_sensitivity_gramians_are_made_once(spark, sf):
    for _, _, cells, _ in queries._epa_fits(spark, sf):
        plan = cells._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan and "Generate" not in plan and "epa" not in plan


def test_fits_take_few_rounds(spark, sf, monkeypatch):
    """Steps start from the curvature between terms: a cross-validation of all penalties takes a few aggregations (over 100 without), at the same minimum."""
    packed = L.pack(B.with_folds(A.contests(spark, sf), A.folds(spark, sf)), "win")
    rows, size = packed.rows.cache(), len(packed.terms)
    penalties, left = np.array([1.0, 1e-2, 1e-3, 1e-4]), np.array([1, 2, 3, 4])
    theta, loss, gradient, rounds = L.minimise(rows, "win", size, penalties, left)
    assert gradient.max() < 1e-6 and rounds.max() <= 15
    monkeypatch.setattr(L, "CURVED_TERMS", 0)
    plain, low, gradient, many = L.minimise(rows, "win", size, penalties, left)
    assert gradient.max() < 1e-6 and many.max() > 2 * rounds.max() and np.abs(loss - low).max() < 1e-8
