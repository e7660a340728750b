"""Ridge paired-comparison fits with MLlib; cross-validation by game with all penalties and folds side by side."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.operators import lanes as L
from duelgrid.operators.baselines import with_folds
from duelgrid.operators.contests import classes_of, model_sample, tasks_for
from duelgrid.operators.design import center_coefficients
from duelgrid.params import Params

#: The largest gradient of a finished fit, and of a lane of the cross-validation.
FINISHED, LANE_TOLERANCE = 1e-3, 1e-8
#: Clips of the probabilities under which held-out losses are told.
CLIPS = (1e-15, 1e-5)


@dataclass
class RidgeFit:
    model: str
    terms: list[str]
    coefficients: DataFrame
    penalty: float
    curve: list[tuple[float, float, float]]
    boundary: bool
    status: str = "complete"
    #: Largest absolute gradient of the penalised mean loss.
    gradient: float = float("nan")
    #: (fold, rows, loss under each clip) of the fold fits at the chosen penalty.
    folds: list[tuple] = field(default_factory=list)


def _keys(rows: DataFrame, column: Column) -> list[str]:
    """The players of a role, in order; as long as the vocabulary."""
    return [r["k"] for r in rows.select(F.explode(column).alias("k")).distinct().orderBy("k").collect()]


def vectors(contests: DataFrame, model: str, weight: Column | None = None, roles: tuple[str, ...] = ("rusher", "blocker")) -> tuple[DataFrame, list[str], np.ndarray]:
    """(label, weight, features) of the distinct design rows of a model, the terms, and the sign of each term's column.

    Contests with the same players, help and class are one weighted row: the loss is the same and the solver reads
    fewer rows. Opponents enter as 1 / group size (a count vector over its sum); the model's minus is their sign.
    """
    rows = model_sample(contests, model)
    label = F.col("win_target").cast("int").cast("string") if model == "win" else F.col("severity_outcome")
    keys = ["cls", "rusher_key", "blocker_keys", "double_team", "double_team_unknown"]
    grouped = rows.withColumn("cls", label).withColumn("blocker_keys", F.array_sort("blocker_keys")).repartition(tasks_for(contests), *keys).groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("weight")).where("weight > 0")
    grouped = grouped.withColumn("rusher_keys", F.array("rusher_key"))
    inputs, terms, signs = [], [], []
    for role, column, sign in (("rusher", "rusher_keys", 1.0), ("blocker", "blocker_keys", -1.0)):
        known = _keys(grouped, F.col(column)) if role in roles else []
        if known:
            counted = CountVectorizerModel.from_vocabulary(known, inputCol=column, outputCol=f"_{role}_n").transform(grouped)
            grouped = Normalizer(p=1.0, inputCol=f"_{role}_n", outputCol=f"_{role}").transform(counted)
            inputs.append(f"_{role}")
            terms += [f"{role}::{k}" for k in known]
            signs += [sign] * len(known)
    used = grouped.agg(*(F.max(f).alias(f) for f in ("double_team", "double_team_unknown"))).first()
    for flag in ("double_team", "double_team_unknown"):
        if used[flag]:
            inputs.append(flag)
            terms.append(flag)
            signs.append(1.0)
    packed = VectorAssembler(inputCols=inputs, outputCol="features").transform(grouped) if inputs else grouped
    index = F.array_position(F.array(*(F.lit(c) for c in classes_of(model))), F.col("cls")).cast("double") - 1
    return packed.select("weight", index.alias("label"), *(["features"] if inputs else [])), terms, np.array(signs)


def _estimator(model: str, penalty: float, params: Params) -> LogisticRegression:
    return LogisticRegression(family="binomial" if model == "win" else "multinomial", regParam=penalty, elasticNetParam=0.0, standardization=False, weightCol="weight", tol=params.tolerance, maxIter=500)


def _tables(fitted, model: str) -> tuple[np.ndarray, np.ndarray]:
    """([class, column] coefficients, [class] intercepts) of the classes with a predictor of their own."""
    if model == "win":
        return fitted.coefficients.toArray()[None, :], np.array([fitted.intercept])
    return fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()


def largest_gradient(fitted, rows: DataFrame, model: str, penalty: float) -> float:
    """The largest absolute slope of the penalised mean loss at the fit: sums of features weighed by chance less outcome."""
    beta, _ = _tables(fitted, model)
    held = fitted.transform(rows).withColumn("_p", vector_to_array("probability"))
    sums, places = [F.sum("weight").alias("w")], [1] if model == "win" else range(len(beta))
    for i, c in enumerate(places):
        chance, own = F.col("weight") * F.col("_p")[c], F.col("weight") * (F.col("label") == c).cast("double")
        sums += [Summarizer.metrics("sum").summary(F.col("features"), chance).alias(f"p{i}"), Summarizer.metrics("sum").summary(F.col("features"), own).alias(f"y{i}"), F.sum(chance).alias(f"cp{i}"), F.sum(own).alias(f"cy{i}")]
    row = held.agg(*sums).first()
    most = 0.0
    for i in range(len(places)):
        slope = (row[f"p{i}"]["sum"].toArray() - row[f"y{i}"]["sum"].toArray()) / row["w"] + penalty * beta[i]
        most = max(most, float(np.abs(slope).max(initial=0.0)), abs(row[f"cp{i}"] - row[f"cy{i}"]) / row["w"])
    return most


def _long(spark, fitted, model: str, terms: list[str], signs: np.ndarray) -> DataFrame:
    beta, constants = _tables(fitted, model)
    rows = []
    for name, values, constant in zip(("1",) if model == "win" else classes_of(model), beta, constants):
        rows += [(model, t, name, float(v)) for t, v in zip(terms, values * signs)] + [(model, "(Intercept)", name, float(constant))]
    return center_coefficients(spark.createDataFrame(rows, "model string, term string, cls string, coefficient double"))


def check_classes(packed: L.Packed, folds: int) -> None:
    """Every class must occur in every training part of the cross-validation."""
    labels = range(len(classes_of(packed.model)))
    found = {(r["label"], r["fold"]) for r in packed.rows.select("label", "fold").distinct().collect()}
    for k in range(1, folds + 1):
        lost = [classes_of(packed.model)[c] for c in labels if not any(label == c and fold != k for label, fold in found)]
        if lost:
            raise ValueError(f"No {', '.join(lost)} outside fold {k}")


def cross_validate(packed: L.Packed, penalties: list[float], folds: int) -> tuple[list[tuple[float, float, float]], dict[float, list[tuple]]]:
    """((penalty, loss, standard error) by penalty, (fold, rows, losses under CLIPS) by penalty).

    Each penalty and left-out fold is a lane of one fit; the loss of a penalty is the row-weighted mean over folds.
    """
    kind, size = packed.model, len(packed.terms)
    pairs = [(p, k) for p in penalties for k in range(1, folds + 1)]
    lanes, left = np.array([p for p, _ in pairs]), np.array([k for _, k in pairs])
    theta, _, _, _ = L.minimise(packed.rows, kind, size, lanes, left, tolerance=LANE_TOLERANCE)
    told = L.held_out_losses(packed.rows, kind, size, theta, left, CLIPS)
    curve, parts = [], {}
    for at, penalty in enumerate(penalties):
        here = told[at * folds : (at + 1) * folds]
        rows, loss = here[:, 0], here[:, 1]
        mean = float((rows * loss).sum() / rows.sum())
        spread = float((rows * (loss - mean) ** 2).sum() / rows.sum())
        curve.append((penalty, mean, (spread / (folds - 1)) ** 0.5))
        parts[penalty] = [(k + 1, *map(float, here[k])) for k in range(folds)]
    return curve, parts


def best_penalty(curve: list[tuple[float, float, float]]) -> float:
    """The penalty of the smallest loss; of equal ones the largest."""
    low = min(loss for _, loss, _ in curve)
    return max(p for p, loss, _ in curve if loss <= low)


def one_se_penalty(curve: list[tuple[float, float, float]]) -> float:
    """The largest penalty whose loss is within one standard error of the smallest."""
    _, low, se = min(curve, key=lambda c: (c[1], -c[0]))
    return max(p for p, loss, _ in curve if loss <= low + se)


def refit_folds(contests: DataFrame, model: str, folds: DataFrame, penalty: float, saved_loss: float | None = None, params: Params = Params(), tolerance: float = 1e-6) -> list[tuple]:
    """(fold, rows, losses under CLIPS) of the fold fits at one penalty; their mean must agree with the saved curve's."""
    packed = L.pack(with_folds(contests, folds), model)
    rows = packed.rows.cache()
    try:
        curve, parts = cross_validate(L.Packed(rows, packed.terms, model), [penalty], params.folds)
    finally:
        rows.unpersist()
    if saved_loss is not None and abs(curve[0][1] - saved_loss) > tolerance:
        raise ValueError(f"Fold losses of {model} ({curve[0][1]}) don't agree with the saved curve ({saved_loss})")
    return parts[penalty]


def fit_model(contests: DataFrame, model: str, folds: DataFrame | None = None, penalties: list[float] | None = None, fixed: float | None = None, params: Params = Params(), weight: Column | None = None, roles: tuple[str, ...] = ("rusher", "blocker")) -> RidgeFit:
    """Fit at a fixed penalty, or at the one that cross-validation by game prefers; centred coefficients in long form.

    A class that doesn't occur gives the status `nonestimable` and no coefficients; a fit whose gradient stays above
    FINISHED has the status `unconverged`. Copies of a game (`weight`) follow its fold.
    """
    spark, curve, parts = contests.sparkSession, [], {}
    if fixed is None:
        penalties = penalties or params.penalty_grid()
        packed = L.pack(with_folds(contests, folds), model, weight, roles)
        held = packed.rows.cache()
        try:
            packed = L.Packed(held, packed.terms, model)
            check_classes(packed, params.folds)
            curve, parts = cross_validate(packed, penalties, params.folds)
        finally:
            held.unpersist()
        fixed = best_penalty(curve)
    rows, terms, signs = vectors(contests, model, weight, roles)
    rows = rows.cache()
    try:
        if rows.select("label").distinct().count() < len(classes_of(model)):
            empty = spark.createDataFrame([], "model string, term string, cls string, coefficient double")
            return RidgeFit(model, terms, empty, fixed, [], False, "nonestimable")
        fitted = _estimator(model, fixed, params).fit(rows)
        gradient = largest_gradient(fitted, rows, model, fixed)
        status = "complete" if gradient <= max(FINISHED, params.tolerance) else "unconverged"
        boundary = bool(curve) and fixed in (max(penalties), min(penalties))
        return RidgeFit(model, terms, _long(spark, fitted, model, terms, signs), fixed, curve, boundary, status, gradient, parts.get(fixed, []))
    finally:
        rows.unpersist()


def centred_tables(terms: list[str], model: str, theta: np.ndarray) -> np.ndarray:
    """[lane, class, term and intercept]: coefficients centred over classes, then over each role's players, whose mean the intercept takes."""
    table = theta.reshape(len(theta), L.head_count(model), len(terms) + 1)
    if L.head_count(model) > 1:
        table = table - table.mean(axis=1, keepdims=True)
    else:
        table = table.copy()
    for role, sign in (("rusher::", 1.0), ("blocker::", -1.0)):
        at = [i for i, t in enumerate(terms) if t.startswith(role)]
        mean = table[:, :, at].mean(axis=2)
        table[:, :, at] -= mean[:, :, None]
        table[:, :, -1] += sign * mean
    return table


def weekly_fits(contests: DataFrame, model: str, penalty: float, weeks: list[int]) -> tuple[list[str], np.ndarray, dict[int, str]]:
    """(terms, [week, class, term and intercept] centred coefficients, status by week) of the cumulative fits at one penalty.

    The weeks are lanes of one fit over the season's vocabulary: who hasn't taken part yet has the coefficient 0 before
    centring. A week in which a class hasn't occurred yet is `nonestimable`, one whose gradient stays above FINISHED
    `unconverged`.
    """
    packed = L.pack(contests.withColumn("fold", F.col("week")), model)
    rows, size = packed.rows.cache(), len(packed.terms)
    try:
        first = {r["label"]: r["week"] for r in rows.groupBy("label").agg(F.min("fold").alias("week")).collect()}
        theta, _, gradient, _ = L.minimise(rows, model, size, np.full(len(weeks), penalty), np.array(weeks), tolerance=LANE_TOLERANCE, upto=True)
    finally:
        rows.unpersist()
    table = centred_tables(packed.terms, model, theta)
    known = len(first) == len(classes_of(model))
    status = {w: "nonestimable" if not known or w < max(first.values()) else "complete" if gradient[i] <= FINISHED else "unconverged" for i, w in enumerate(weeks)}
    return packed.terms, table, status
