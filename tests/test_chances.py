"""Sums of probabilities as products of matrices and from Chebyshev points, against pairs computed one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.functions import chances as H
from duelgrid.functions.scalars import logistic, ordinal_probabilities
from duelgrid.operators import scoring as S


def plain(base, scale, weight, own):
    eta = base[:, None, :] + scale[:, None, None] * own
    if base.shape[1] == 1:
        each = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    else:
        powers = np.exp(eta - eta.max(axis=2, keepdims=True))
        each = powers / powers.sum(axis=2, keepdims=True)
    return np.einsum("rpc,r->pc", each, weight)


@pytest.mark.parametrize("size", [0.0, 1.0, 40.0, 2000.0])
@pytest.mark.parametrize("classes", [1, 4])
def test_products_of_matrices(classes, size):
    rng = np.random.default_rng(3)
    base, own = rng.normal(size=(200, classes)) * size, rng.normal(size=(30, classes)) * size
    scale, weight = rng.choice([1.0, -0.5, -1 / 3], 200), rng.random(200) / 100
    assert np.abs(H.class_sums(base, scale, weight, own) - plain(base, scale, weight, own)).max() < 1e-13
    assert H.class_sums(base, scale, weight, own[:0]).shape == (0, classes)


@pytest.mark.parametrize("spread", [0.01, 1.0, 6.0])
def test_points_are_as_near_as_proven(spread):
    rng = np.random.default_rng(4)
    own, base, scale, weight = rng.uniform(-spread, spread, 3000), rng.normal(size=(100, 1)) * 3, rng.choice([1.0, -0.5], 100), np.full(100, 0.01)
    points, weights = H.chebyshev_nodes(own.min(), own.max(), len(own))
    own = np.append(own, points[:3])
    found = H.interpolate(points, weights, H.class_sums(base, scale, weight, points[:, None]), own)
    assert len(points) < 200 and np.abs(found - plain(base, scale, weight, own[:, None])).max() < 5e-12


def test_no_points_where_they_do_not_pay():
    assert H.chebyshev_nodes(0.0, 1.0, 3) is None and H.chebyshev_nodes(None, None, 0) is None and H.chebyshev_nodes(float("nan"), 1.0, 9) is None
    assert len(H.chebyshev_nodes(0.5, 0.5, 9)[0]) == 1


@pytest.mark.parametrize("cuts", [None, [0.0, 1.2, 2.2]])
def test_players_from_points(spark, cuts):
    """More players than points: the same sums as when each meets every context; one player lies on a point."""
    rng = np.random.default_rng(5)
    own = [*rng.uniform(-1, 1, 400), -1.0, 1.0, float(H.chebyshev_nodes(-1.0, 1.0, 400)[0][2])]
    players = spark.createDataFrame([(f"p{i}", [float(x)]) for i, x in enumerate(own)], "player_key string, own array<double>")
    base = spark.createDataFrame([(float(b), float(s), 0.02) for b, s in zip(rng.normal(size=50) * 2, rng.choice([1.0, -0.5], 50))], "b0 double, scale double, weight double")
    each = (lambda eta: ordinal_probabilities(eta, cuts)) if cuts else (lambda eta: [logistic(eta)])
    wanted = {r.player_key: r for r in S.met_sums(base, players, each).collect()}
    found = S.interpolated_sums(base, players, each).collect()
    assert len(found) == len(wanted) == 403
    for r in found:
        assert all(r[c] == pytest.approx(wanted[r.player_key][c], abs=1e-11) for c in r.asDict() if c[0] == "p" and c != "player_key")
    assert S.interpolated_sums(base, players.where("false"), each).count() == 0


def test_players_and_contexts_in_blocks(spark, monkeypatch):
    """Several blocks of players and many cells of contexts give the sums of one."""
    rng = np.random.default_rng(6)
    rows = [(*map(float, rng.normal(size=4)), float(s), 0.01, i) for i, s in enumerate(rng.choice([1.0, -0.5], 100))]
    base = spark.createDataFrame(rows, "b0 double, b1 double, b2 double, b3 double, scale double, weight double, number long")
    own = rng.normal(size=(20, 4))
    players = spark.createDataFrame([(f"p{i}", [float(x) for x in o]) for i, o in enumerate(own)], "player_key string, own array<double>")
    monkeypatch.setattr(S, "BLOCK_PLAYERS", 7)
    monkeypatch.setattr(S, "CELL_CONTESTS", 10)
    monkeypatch.setattr(S, "CHANCES", 30)
    wanted = plain(np.array([r[:4] for r in rows]), np.array([r[4] for r in rows]), np.full(100, 0.01), own)
    found = {r.player_key: r for r in S.softmax_sums(base, players, 4, 100).collect()}
    assert len(found) == 20 and all(found[f"p{i}"][f"p{c}"] == pytest.approx(wanted[i, c], abs=1e-13) for i in range(20) for c in range(4))
    assert S.softmax_sums(base.where(F.lit(False)), players, 4, 0).count() == 0
