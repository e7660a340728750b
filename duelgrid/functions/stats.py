"""Tie-aware ranks, top-k credit, AUC and guarded quantiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def average_rank(value: Column, keys: list[str], ascending: bool = False) -> Column:
    """Rank within `keys`, ties averaged; null where the value is null (nulls rank after all others)."""
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return F.when(value.isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0))


def top_credit(value: Column, keys: list[str], k: int = 10) -> Column:
    """Share of a place among the k largest; rows tied across the limit share what is left of it."""
    whole: WindowSpec = Window.partitionBy(*keys)
    limit = F.least(F.lit(k), F.count(value).over(whole))
    first = F.rank().over(whole.orderBy(value.desc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (limit - first + 1) / ties)))


def auc(label: Column, rank: Column) -> Column:
    """Mann-Whitney AUC from ascending average ranks of labelled rows; null without both classes."""
    positives = F.count_if(label)
    negatives = F.count_if(~label)
    total = F.sum(F.when(label, rank))
    return F.when((positives > 0) & (negatives > 0), (total - positives * (positives + 1) / 2.0) / (positives * negatives))


def guarded_percentile(value: Column, share: float) -> Column:
    """Linear-interpolation quantile, null if any value is null or not finite."""
    return F.when(F.count_if(~finite(value)) == 0, F.percentile(value, F.lit(share)))


def guarded_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation, null where either side is constant."""
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
