"""Proportional-odds model: gradients summed in Spark over grouped rows, short updates on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.operators import lanes as L
from duelgrid.operators.baselines import with_folds
from duelgrid.operators.contests import model_sample
from duelgrid.params import CLASSES

#: The largest gradient of a finished fit, and how often a grid grows at a boundary at most.
TOLERANCE, EXTENSIONS = 2e-5, 12


def ordinal_groups(contests: DataFrame) -> DataFrame:
    """Distinct design rows of the severity sample (opponents sorted) with their counts by class."""
    rows = model_sample(contests, "severity").withColumn("keys", F.array_sort("blocker_keys"))
    counts = [F.count_if(F.col("severity_outcome") == c).alias(f"n_{c}") for c in CLASSES]
    return rows.groupBy("rusher_key", "keys", "double_team", "double_team_unknown").agg(*counts)


@dataclass
class OrdinalFit:
    terms: list[str]
    beta: np.ndarray
    cuts: list[float]
    penalty: float
    gradient: float
    loss: float

    @property
    def converged(self) -> bool:
        return self.gradient < TOLERANCE and bool((np.diff(self.cuts) > 1e-8).all())


@dataclass
class OrdinalPath:
    """Cross-validated penalties: (penalty, fold, rows, loss) and (penalty, loss, standard error), largest penalty first."""

    by_fold: list[tuple[float, int, float, float]]
    curve: list[tuple[float, float, float]]
    penalty: float
    one_se: float
    extensions: int
    fit: OrdinalFit


def _fit(packed: L.Packed, theta: np.ndarray, penalty: float, loss: float, gradient: float) -> OrdinalFit:
    size = len(packed.terms)
    return OrdinalFit(packed.terms, theta[:size], L.ordinal_cuts(theta[None, :], size)[0].tolist(), penalty, float(gradient), float(loss))


def fit_ordinal(contests: DataFrame, penalty: float, tolerance: float = TOLERANCE, rounds: int = 400) -> OrdinalFit:
    """Minimise mean loss + penalty / 2 |beta|^2 by L-BFGS; every round is one aggregation over the packed rows.

    Cuts are the first cut and exponentials of gaps, so they stay ordered; they aren't penalised. What reaches the driver
    is as long as the vocabulary.
    """
    packed = L.pack(contests, "severity")
    rows = packed.rows.cache()
    try:
        theta, loss, gradient, _ = L.minimise(rows, "ordinal", len(packed.terms), np.array([penalty]), np.array([-1]), tolerance=tolerance, rounds=rounds)
    finally:
        rows.unpersist()
    return _fit(packed, theta[0], penalty, loss[0], gradient[0])


def ordinal_path(contests: DataFrame, folds: DataFrame, penalties: list[float], k: int, tolerance: float = TOLERANCE, extensions: int = EXTENSIONS) -> OrdinalPath:
    """Choose the penalty by cross-validation over games, then fit all rows at it.

    All penalties and left-out folds are fitted side by side; a decade of penalties that is added where the best one
    lies at a boundary (at most `extensions` times) starts from the lanes at that boundary. Of equal losses the first in
    order of falling penalties wins.
    """
    packed = L.pack(with_folds(contests, folds), "severity")
    rows, size = packed.rows.cache(), len(packed.terms)
    known: dict[float, np.ndarray] = {}
    told: dict[float, np.ndarray] = {}
    try:
        grid, new, added, start = sorted(penalties, reverse=True), sorted(penalties, reverse=True), 0, None
        while True:
            pairs = [(p, f) for p in new for f in range(1, k + 1)]
            lanes, left = np.array([p for p, _ in pairs]), np.array([f for _, f in pairs])
            begin = None if start is None else np.tile(start, (len(new), 1))
            theta, _, gradient, _ = L.minimise(rows, "ordinal", size, lanes, left, begin, tolerance)
            if gradient.max() >= tolerance:
                raise ValueError(f"A fold of the ordinal path didn't converge: gradient {gradient.max()}")
            losses = L.held_out_losses(rows, "ordinal", size, theta, left, (1e-15,))
            for i, p in enumerate(new):
                known[p], told[p] = theta[i * k : (i + 1) * k], losses[i * k : (i + 1) * k]
            means = {p: float((t[:, 0] * t[:, 1]).sum() / t[:, 0].sum()) for p, t in told.items()}
            best = min(grid, key=lambda p: (means[p], -p))
            side = "upper" if best == grid[0] else "lower" if best == grid[-1] else None
            if side is None or added >= extensions or len(grid) < 2:
                break
            start = known[best]
            longer = extend_grid(grid, side)
            new, grid, added = [p for p in longer if p not in told], longer, added + 1
        theta, loss, gradient, _ = L.minimise(rows, "ordinal", size, np.array([best]), np.array([-1]), known[best].mean(axis=0)[None, :], tolerance)
    finally:
        rows.unpersist()
    curve = []
    for p in grid:
        spread = float((told[p][:, 0] * (told[p][:, 1] - means[p]) ** 2).sum() / told[p][:, 0].sum())
        curve.append((p, means[p], (spread / (k - 1)) ** 0.5))
    limit = next(loss_ + se for p, loss_, se in curve if p == best)
    by_fold = [(p, f + 1, float(told[p][f, 0]), float(told[p][f, 1])) for p in grid for f in range(k)]
    return OrdinalPath(by_fold, curve, best, max(p for p, loss_, _ in curve if loss_ <= limit), added, _fit(packed, theta[0], best, loss[0], gradient[0]))


def coefficients_of(fit: OrdinalFit, spark) -> DataFrame:
    """Centred effects in long form (model severity, class 1); the roles' means move into the cuts' common shift."""
    from duelgrid.operators.design import center_coefficients

    rows = [("severity", t, "1", float(b)) for t, b in zip(fit.terms, fit.beta)] + [("severity", "(Intercept)", "1", 0.0)]
    return center_coefficients(spark.createDataFrame(rows, "model string, term string, cls string, coefficient double"))


def extend_grid(grid: list[float], side: str) -> list[float]:
    """A further decade of penalties at the same log spacing, above the largest or below the smallest."""
    ordered = sorted(grid, reverse=True)
    ratio = ordered[0] / ordered[1]
    count = max(1, round(np.log(10) / np.log(ratio)))
    more = [ordered[0] * ratio**i for i in range(1, count + 1)] if side == "upper" else [ordered[-1] / ratio**i for i in range(1, count + 1)]
    return sorted({*ordered, *more}, reverse=True)
