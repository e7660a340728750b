"""Scalar functions of the rating pipeline as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(name: Column) -> Column:
    """Trimmed, lower-cased, letters, digits and single spaces only."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9 ]", ""), " +", " ")


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(values: list[Column]) -> list[Column]:
    """Row-wise, shifted by the largest value."""
    most = F.greatest(*values) if len(values) > 1 else values[0]
    parts = [F.exp(v - most) for v in values]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ordinal_probabilities(eta: Column, cuts: list[float]) -> list[Column]:
    """P(class) under P(Y <= j) = logistic(cut_j - eta), from log-scale differences that stay exact in the tails."""
    log_below = [-softplus(eta - c) for c in cuts]
    log_above = [-softplus(F.lit(float(c)) - eta) for c in cuts]
    out = [F.exp(log_below[0])]
    for low, high in zip(range(len(cuts) - 1), range(1, len(cuts))):
        gap = float(cuts[high] - cuts[low])
        # logistic(c2 - eta) - logistic(c1 - eta) = P(Y <= c2) P(Y > c1) (1 - exp(c1 - c2))
        out.append(F.exp(log_below[high] + log_above[low]) * F.lit(-_expm1(-gap)))
    return [*out, F.exp(log_above[-1])]


def _expm1(x: float) -> float:
    import math

    return math.expm1(x)
