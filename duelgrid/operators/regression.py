"""Outcome weights from a two-way fixed-effects regression: Gramians in Spark, a small solve on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gramian(design: DataFrame, target: DataFrame, row_keys: list[str], by: list[str]) -> DataFrame:
    """(by, a, b, value): sums of w x_a x_b for a <= b, with the target as term `@y`, by game or replicate.

    A row's few entries are gathered into an array once; pairs are made inside the row, so nothing is joined to itself.
    """
    entries = design.unionByName(target.select(*row_keys, *[k for k in by if k not in row_keys], F.lit("@y").alias("term"), F.col("y").alias("value")))
    return row_gramian(entries.groupBy(*dict.fromkeys([*row_keys, *by])).agg(F.collect_list(F.struct("term", "value")).alias("x")), by)


def row_gramian(rows: DataFrame, by: list[str], y: str | None = None) -> DataFrame:
    """`gramian` of rows that hold their entries as an array `x` already, and the target as column `y`: only sums are shuffled."""
    x = F.col("x") if y is None else F.concat("x", F.array(F.struct(F.lit("@y").alias("term"), F.col(y).cast("double").alias("value"))))
    first = rows.select(*by, F.array_sort(x).alias("x")).select(*by, "x", F.posexplode("x").alias("_i", "_a"))
    pairs = first.select(*by, "_a", F.explode(F.slice("x", F.col("_i") + 1, F.size("x"))).alias("_b"))
    return pairs.groupBy(*by, F.col("_a.term").alias("a"), F.col("_b.term").alias("b")).agg(F.sum(F.col("_a.value") * F.col("_b.value")).alias("value"), F.count(F.lit(1)).alias("rows"))


def draw_gramians(by_game: DataFrame, draws: DataFrame) -> DataFrame:
    """Gramians of all replicates at once: per-game sums times how often a replicate holds the game."""
    return by_game.join(draws, "game_id").groupBy("replicate_id", "a", "b").agg(F.sum(F.col("value") * F.col("copies")).alias("value"), F.sum(F.col("rows") * F.col("copies")).alias("rows"))


@dataclass(frozen=True)
class FixedEffectsFit:
    coefficients: dict[str, float]
    estimable: dict[str, bool]
    references: tuple[str, ...]
    absent: tuple[str, ...]
    rank: int
    pivot_ratio: float

    def weights(self) -> dict[str, float]:
        """What a win and a pressure count for, in sacks; NaN where the sack effect isn't estimable or is zero."""
        beta = {k: self.coefficients.get(t, 0.0) if self.estimable.get(t, False) else float("nan") for k, t in (("win", "N_W"), ("pressure", "N_P"), ("sack", "N_S"))}
        sack = beta["sack"]
        if not np.isfinite(sack) or sack == 0:
            return {"loss": 0.0, "win": float("nan"), "pressure": float("nan"), "sack": float("nan")}
        return {"loss": 0.0, **{k: v / sack for k, v in beta.items()}}


def solve_fixed_effects(cells: list[tuple[str, str, float]], levels: list[str], tolerance: float = 1e-10, null_tolerance: float = 1e-7) -> FixedEffectsFit:
    """Solve from Gramian cells (a, b, value). `levels` names all fixed-effect terms, `QB::x` and `DEF::x`.

    Levels without mass are absent; the heaviest level of each group is the reference (ties: first by name); what the
    others leave undetermined is found by pivoted elimination and set to 0. Each group is then centred to mean 0 over
    its represented levels, the intercept taking the shifts. A term is estimable if it isn't absent and no direction
    that leaves the fit unchanged moves it.
    """
    table = {(a, b): v for a, b, v in cells} | {(b, a): v for a, b, v in cells}
    seen = {a for a, _ in table} - {"@y"}
    names = sorted(seen | set(levels), key=lambda t: (t.startswith(("QB::", "DEF::")), t))
    groups = {g: [t for t in names if t.startswith(g)] for g in ("QB::", "DEF::")}
    mass = {t: table.get((t, t), 0.0) for t in names}
    absent = [t for g in groups.values() for t in g if mass[t] <= 0]
    references = [max((t for t in g if mass[t] > 0), key=lambda t: (mass[t], [-ord(c) for c in t])) for g in groups.values() if any(mass[t] > 0 for t in g)]
    used = [t for t in names if t not in absent and t not in references]
    matrix = np.array([[table.get((a, b), 0.0) for b in used] for a in used])
    right = np.array([table.get((a, "@y"), 0.0) for a in used])
    scale = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    work, order, kept = matrix / np.outer(scale, scale), [], []
    left = work.copy()
    pivots = []
    for i in range(len(used)):  # in the order of the columns, as a rank-revealing elimination that only defers
        if left[i, i] > max(tolerance, 1e-9):
            pivots.append(left[i, i])
            kept.append(i)
            left = left - np.outer(left[:, i], left[i, :]) / left[i, i]
        else:
            order.append(i)
    solution = np.zeros(len(used))
    if kept:
        solution[kept] = np.linalg.solve(work[np.ix_(kept, kept)], (right / scale)[kept])
    beta = dict.fromkeys(names, 0.0) | dict(zip(used, solution / scale))
    free = np.zeros((len(names), len(order)))
    at = {t: i for i, t in enumerate(names)}
    for column, alias in enumerate(order):
        direction = np.zeros(len(used))
        direction[alias] = 1.0
        if kept:
            direction[kept] = -np.linalg.solve(work[np.ix_(kept, kept)], work[kept, alias])
        for i, t in enumerate(used):
            free[at[t], column] = direction[i] / scale[i] * scale[alias]
    for group in groups.values():
        here = [t for t in group if mass[t] > 0]
        if not here:
            continue
        shift = sum(beta[t] for t in here) / len(here)
        null_shift = np.mean([free[at[t]] for t in here], axis=0)
        for t in here:
            beta[t] -= shift
            free[at[t]] -= null_shift
        beta["(Intercept)"] = beta.get("(Intercept)", 0.0) + shift
        free[at["(Intercept)"]] += null_shift
    moved = np.sqrt((free**2).sum(axis=1)) if len(order) else np.zeros(len(names))
    estimable = {t: t not in absent and moved[at[t]] <= null_tolerance for t in names}
    return FixedEffectsFit(beta, estimable, tuple(references), tuple(absent), len(kept), float(min(pivots) / max(pivots)) if pivots else 0.0)


def fit_plays(cells: DataFrame, levels: DataFrame) -> FixedEffectsFit:
    """The fit of one Gramian (terms x terms, as many as there are levels)."""
    names = [f"{r['kind']}::{r['level']}" for r in levels.collect()]
    return solve_fixed_effects([(r["a"], r["b"], r["value"]) for r in cells.select("a", "b", "value").collect()], names)


def solve_draws(drawn: DataFrame, levels: list[str]) -> DataFrame:
    """(replicate_id, term, coefficient, estimable, absent): the fit of every replicate's Gramian (replicate_id, a, b, value)."""

    def solve(part):
        import pandas as pd

        fit = solve_fixed_effects(list(part[["a", "b", "value"]].itertuples(index=False, name=None)), levels)
        terms = list(fit.coefficients)
        return pd.DataFrame({"replicate_id": int(part["replicate_id"].iloc[0]), "term": terms, "coefficient": list(fit.coefficients.values()), "estimable": [fit.estimable[t] for t in terms], "absent": [t in fit.absent for t in terms]})

    # one replicate's cells (terms x terms) are one group: as large as the vocabulary of levels allows, not the data; few bytes, but a
    # solve each: dealt over all cores, where their size would put them into one task
    dealt = drawn.repartition(drawn.sparkSession.sparkContext.defaultParallelism, "replicate_id")
    return dealt.groupBy("replicate_id").applyInPandas(solve, "replicate_id int, term string, coefficient double, estimable boolean, absent boolean")


def draw_weights(fits: DataFrame) -> DataFrame:
    """(replicate_id, cls, weight): what a class counts for in sacks; null where the sack effect isn't estimable or is 0."""
    of = lambda t: F.max(F.when((F.col("term") == t) & F.col("estimable"), F.col("coefficient")))
    wide = fits.groupBy("replicate_id").agg(of("N_W").alias("win"), of("N_P").alias("pressure"), of("N_S").alias("sack"))
    ratio = lambda c: F.try_divide(F.col(c), F.col("sack"))
    pairs = F.array(F.struct(F.lit("loss").alias("cls"), F.lit(0.0).alias("weight")), *(F.struct(F.lit(c).alias("cls"), ratio(c).alias("weight")) for c in ("win", "pressure", "sack")))
    return wide.select("replicate_id", F.explode(pairs).alias("p")).select("replicate_id", "p.*")


def normal_residuals(cells: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(term, residual): sums over the rows of a term's value times what the fit leaves, over the term's length.

    `cells` is a Gramian (a <= b, value), `coefficients` (term, coefficient). A least-squares fit leaves 0 at every term.
    """
    sides = cells.where("a <> '@y' and b <> '@y'")
    turned = sides.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "value")
    fitted = sides.select("a", "b", "value").unionByName(turned).join(coefficients.select(F.col("term").alias("b"), "coefficient"), "b").groupBy("a").agg(F.sum(F.col("value") * F.col("coefficient")).alias("_fitted"))
    target = cells.where("(a = '@y') <> (b = '@y')").select(F.when(F.col("a") == "@y", F.col("b")).otherwise(F.col("a")).alias("a"), F.col("value").alias("_y"))
    length = sides.where("a = b").select("a", F.sqrt("value").alias("_length"))
    met = fitted.join(length, "a").join(target, "a", "left")
    return met.select(F.col("a").alias("term"), ((F.coalesce("_y", F.lit(0.0)) - F.col("_fitted")) / F.col("_length")).alias("residual"))


def coefficient_uncertainty(fits: DataFrame, point: DataFrame) -> DataFrame:
    """Point, mean and quantiles of every term over the draws, and how often it was defined, estimable and absent.

    `fits` has replicate_id, term, coefficient, estimable and absent, `point` term, coefficient and estimable. The identified
    interval is given only if the term is finite and estimable in every draw and in the point.
    """
    from duelgrid.functions.stats import finite

    known = finite(F.col("coefficient"))
    share = lambda test: F.avg(test.cast("double"))
    sums = fits.groupBy("term").agg(
        F.count(F.lit(1)).alias("draws"),
        F.avg(F.when(known, F.col("coefficient"))).alias("mean"),
        *(F.percentile(F.when(known, F.col("coefficient")), F.lit(q)).alias(n) for q, n in ((0.025, "q025"), (0.975, "q975"))),
        share(known).alias("defined_fraction"),
        share(F.col("estimable")).alias("estimable_fraction"),
        share(F.col("absent")).alias("absent_fraction"),
    )
    met = sums.join(point.select("term", F.col("coefficient").alias("point"), F.col("estimable").alias("point_estimable")), "term", "left")
    whole = (F.col("defined_fraction") == 1) & (F.col("estimable_fraction") == 1) & F.coalesce("point_estimable", F.lit(False))
    return met.select("*", F.when(whole, F.col("q025")).alias("identified_q025"), F.when(whole, F.col("q975")).alias("identified_q975"))


def coefficient_covariance(fits: DataFrame, terms: list[str]) -> DataFrame:
    """(a, b, covariance) over the draws of the given terms, a <= b; pairs are made inside one draw's row."""
    held = fits.where(F.col("term").isin(*terms)).groupBy("replicate_id").agg(F.array_sort(F.collect_list(F.struct("term", "coefficient"))).alias("x"))
    first = held.select("x", F.posexplode("x").alias("_i", "_a")).select("_a", F.explode(F.slice("x", F.col("_i") + 1, F.size("x"))).alias("_b"))
    return first.groupBy(F.col("_a.term").alias("a"), F.col("_b.term").alias("b")).agg(F.covar_samp("_a.coefficient", "_b.coefficient").alias("covariance"))


def prediction_metrics(rows: DataFrame, primary: str, baseline: str, y: str, weight: str) -> DataFrame:
    """Weighted MSE and MAE of two predictions, the improvement, its percentage (null for a zero baseline) and sizes."""
    w = F.col(weight)
    mean = lambda e: F.sum(w * e) / F.sum(w)
    sums = rows.agg(
        mean((F.col(y) - F.col(primary)) ** 2).alias("m1"), mean((F.col(y) - F.col(baseline)) ** 2).alias("b1"), mean(F.abs(F.col(y) - F.col(primary))).alias("m2"), mean(F.abs(F.col(y) - F.col(baseline))).alias("b2"), F.sum(w).alias("weighted_test_plays"), F.count_if(w > 0).alias("unique_test_plays")
    )
    both = F.explode(F.array(F.struct(F.lit("MSE").alias("metric"), F.col("m1").alias("m"), F.col("b1").alias("b")), F.struct(F.lit("MAE").alias("metric"), F.col("m2").alias("m"), F.col("b2").alias("b"))))
    long = sums.select(both.alias("e"), "weighted_test_plays", "unique_test_plays")
    return long.select(F.col("e.metric").alias("metric"), F.col("e.m").alias("model_loss"), F.col("e.b").alias("baseline_loss"), (F.col("e.b") - F.col("e.m")).alias("improvement"), F.when(F.col("e.b") > 0, 100 * (F.col("e.b") - F.col("e.m")) / F.col("e.b")).alias("percent_improvement"), "weighted_test_plays", "unique_test_plays")
