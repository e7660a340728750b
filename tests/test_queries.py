"""Registered fits cover the whole job: every week, both models, the whole grid, a fit that has converged."""

from types import SimpleNamespace

import numpy as np

from duelgrid.operators.ordinal import OrdinalFit
from duelgrid.params import Params
from duelgrid.plans import queries


def test_fits_cover_weeks_models_and_grid(spark, sf, monkeypatch):
    calls = []
    nothing = spark.createDataFrame([], "model string, term string, cls string, coefficient double")

    def fit(contests, model, folds=None, penalties=None, fixed=None):
        calls.append((model, penalties))
        return SimpleNamespace(coefficients=nothing, status="complete")

    asked = []

    def weekly(contests, model, penalty, weeks):
        asked.append((model, penalty, tuple(weeks)))
        return [], np.zeros((len(weeks), 1, 1)), dict.fromkeys(weeks, "complete")

    def scores(contests, model, role, terms, tables, lanes, weights):
        return spark.createDataFrame([(w, model, role, "id:0") for w in lanes], "week int, model string, role string, player_key string")

    monkeypatch.setattr(queries, "weekly_fits", weekly)
    monkeypatch.setattr(queries, "lane_scores", scores)
    monkeypatch.setattr(queries.K, "exposed_by_week", lambda found, contests, last_week: found)
    rows = {(r["week"], r["model"], r["role"]) for r in queries.weekly_scores(spark, sf).collect()}
    assert asked == [(m, 0.01, tuple(range(1, 19))) for m in ("win", "severity")]
    assert rows == {(w, m, r) for w in range(1, 19) for m in ("win", "severity") for r in ("Rusher", "Blocker")}
    monkeypatch.setattr(queries, "fit_model", fit)
    queries.ridge_win(spark, sf)
    assert calls[-1] == ("win", Params().penalty_grid())


def test_ordinal_fit_tells_convergence(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "fit_ordinal", lambda contests, *rest: asked.append(rest) or OrdinalFit(["rusher::a", "blocker::b"], np.zeros(2), [0.0, 1.0, 2.0], 0.01, 1e-3, 1.0))
    found = queries.ordinal_fit(spark, sf).collect()
    assert asked == [(0.01, 2e-5)] and found and not any(r["converged"] for r in found)
