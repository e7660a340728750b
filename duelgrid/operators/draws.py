"""Bootstrap replicates of relational statistics: per-game sums times multiplicities, all replicates in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.functions.stats import average_rank, finite, guarded_percentile, top_credit
from duelgrid.operators.baselines import class_weights, cv_summary, draw_losses, select_strength, signed, with_folds
from duelgrid.operators.contests import class_masses, observations, smooth
from duelgrid.params import STRENGTHS, Params
from duelgrid.sources.stage import kept


def draw_masses(rows: DataFrame, draws: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(masses, shares) by replicate (and `keys`): rows are summed by game once, then weighed by each replicate."""
    by_game = class_masses(rows, [*keys, "game_id"])
    group = ["replicate_id", *keys]
    weighed = by_game.join(draws.select("replicate_id", "game_id", "copies"), "game_id")
    masses = weighed.groupBy(*group, "model", "role", "player_key", "cls").agg(F.sum(F.col("mass") * F.col("copies")).alias("mass"), F.sum(F.col("interactions") * F.col("copies")).alias("interactions"))
    counts = rows.groupBy(*keys, "game_id", "model", "cls").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(draws.select("replicate_id", "game_id", "copies"), "game_id").groupBy(*group, "model", "cls").agg(F.sum(F.col("n") * F.col("copies")).alias("n"))
    totals = counts.groupBy(*group, "model").agg(F.sum("n").alias("t"))
    return masses, counts.join(totals, [*group, "model"]).select(*group, "model", "cls", (F.col("n") / F.col("t")).alias("share"))


def bootstrap_scores(contests: DataFrame, draws: DataFrame, params: Params = Params(), share: float = 1.0) -> DataFrame:
    """Shrunken scores of every player of the vocabulary in every replicate, plain and credited, with presence.

    `share` is the credit of a sack in the credited score (a draw's own mean credit where that is computed).
    """
    rows = observations(contests)
    masses, shares = draw_masses(rows, draws, [])
    players = class_masses(rows, []).select("model", "role", "player_key").distinct()
    totals = masses.groupBy("replicate_id", "model", "role", "player_key").agg(F.sum("mass").alias("total"))
    # the grid is players x replicates x classes: as long as the result itself
    grid = players.join(shares, "model").join(masses.drop("interactions"), ["replicate_id", "model", "role", "player_key", "cls"], "left").join(totals, ["replicate_id", "model", "role", "player_key"], "left").fillna({"mass": 0.0, "total": 0.0})
    strength = F.when(F.col("model") == "win", params.season_strength["win"]).otherwise(params.season_strength["severity"])
    value = smooth(F.col("mass"), F.col("total"), F.col("share"), strength)
    weight = class_weights(F.col("model"), F.col("cls"), params.severity_weights)
    credit = weight * F.when(F.col("cls") == "sack", share).otherwise(1.0)
    sums = grid.groupBy("replicate_id", "model", "role", "player_key").agg(F.sum(value * weight).alias("plain"), F.sum(value * credit).alias("credited"), (F.max("total") > 0).alias("present_in_draw"))
    kinds = F.array(F.struct(F.when(F.col("model") == "win", "rate").otherwise("expected_severity").alias("score_type"), F.col("plain").alias("value")), F.struct(F.when(F.col("model") == "severity", "expected_credited_severity").alias("score_type"), F.col("credited").alias("value")))
    long = sums.select("replicate_id", "model", "role", "player_key", "present_in_draw", F.explode(kinds).alias("k")).where("k.score_type is not null")
    return long.select("replicate_id", "model", "role", "player_key", "present_in_draw", F.col("k.score_type").alias("score_type"), signed(F.col("model"), F.col("role"), F.col("k.value")).alias("score"))


def rating_intervals(draws: DataFrame) -> DataFrame:
    """Mean, deviation, quantiles, rank quantiles and top-10 probability of every score over the replicates."""
    key = ["replicate_id", "model", "score_type", "role"]
    rows = draws.select("*", average_rank(F.col("score"), key).alias("_rank"), top_credit(F.col("score"), key).alias("_credit"))
    return rows.groupBy("model", "score_type", "role", "player_key").agg(
        F.avg("score").alias("score_mean"),
        F.stddev_samp("score").alias("score_sd"),
        *(guarded_percentile(F.col("score"), q).alias(n) for q, n in ((0.025, "q025"), (0.5, "q50"), (0.975, "q975"))),
        *(guarded_percentile(F.col("_rank"), q).alias(n) for q, n in ((0.025, "rank_q025"), (0.975, "rank_q975"))),
        F.count(F.lit(1)).alias("n_boot"),
        F.avg(finite(F.col("score")).cast("double")).alias("defined_fraction"),
        F.avg(F.col("present_in_draw").cast("double")).alias("presence_rate"),
        F.avg("_credit").alias("top10_probability"),
    )


def validation_draw_losses(contests: DataFrame, draws: DataFrame, strengths: tuple[float, ...] = STRENGTHS, last_train_week: int = 15) -> DataFrame:
    """Hold-out loss of every replicate, model and strength: profiles of its training games, loss on its test games."""
    rows = observations(contests)
    masses, shares = draw_masses(rows.where(F.col("week") <= last_train_week), draws, [])
    return draw_losses(rows.where(F.col("week") > last_train_week), draws, [], strengths, masses, shares)


def draw_cv_losses(contests: DataFrame, draws: DataFrame, folds: DataFrame, strengths: tuple[float, ...] = STRENGTHS, last_train_week: int = 15) -> DataFrame:
    """Loss of every replicate, fold, model and strength on the training games; a game's copies stay in one fold."""
    rows = with_folds(observations(contests.where(F.col("week") <= last_train_week)), folds)
    own = kept(draw_masses(rows, draws, ["fold"])[0], "draw-masses")
    keys = ["replicate_id", "model", "role", "player_key", "cls"]
    parts = folds.select("fold").distinct()
    whole = own.groupBy(*keys).agg(F.sum("mass").alias("m"), F.sum("interactions").alias("i"))
    spread = whole.crossJoin(F.broadcast(parts)).join(own, ["fold", *keys], "left").fillna({"mass": 0.0, "interactions": 0})
    masses = spread.select("fold", *keys, F.when(F.col("i") > F.col("interactions"), F.col("m") - F.col("mass")).otherwise(0.0).alias("mass"), (F.col("i") - F.col("interactions")).alias("interactions"))
    # class counts of a complement: the focal players' masses are whole numbers, one a row
    counts = masses.where("role = 'Rusher'").groupBy("replicate_id", "fold", "model", "cls").agg(F.sum("interactions").alias("n"))
    totals = counts.groupBy("replicate_id", "fold", "model").agg(F.sum("n").alias("t"))
    shares = counts.join(totals, ["replicate_id", "fold", "model"]).select("replicate_id", "fold", "model", "cls", (F.col("n") / F.col("t")).alias("share"))
    return draw_losses(rows, draws, ["fold"], strengths, masses, shares)


def tuned_validation(test_losses: DataFrame, cv_losses: DataFrame, saved: DataFrame) -> DataFrame:
    """Fixed-grid and tuned losses of every replicate, paired with the saved model losses of the same draws."""
    selected = select_strength(cv_summary(cv_losses, ["replicate_id"]), ["replicate_id"]).withColumnRenamed("strength", "selected_strength")
    rows = test_losses.join(selected, ["replicate_id", "model"]).join(saved, ["replicate_id", "model"])
    kinds = F.array(F.lit("fixed_grid"), F.when(F.col("strength") == F.col("selected_strength"), "training_cv_selected"))
    rows = rows.select("*", F.explode(kinds).alias("baseline")).where("baseline is not null")
    return rows.select(
        "replicate_id", "model", "baseline", "strength", "selected_strength", F.col("loss").alias("baseline_loss"), "model_loss", (F.col("loss") - F.col("model_loss")).alias("improvement"), (100 * (F.col("loss") - F.col("model_loss")) / F.col("loss")).alias("percent_improvement")
    )


def complete_draws(draws: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """The draws; an error when they are read if a combination of `keys` hasn't exactly the replicates 1..expected."""
    counts = draws.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("replicate_id").alias("_d"), F.min("replicate_id").alias("_low"), F.max("replicate_id").alias("_high"))
    fine = (F.col("_n") == expected) & (F.col("_d") == expected) & (F.col("_low") == 1) & (F.col("_high") == expected)
    lost = F.raise_error(F.concat_ws(" ", F.lit("Incomplete draws of"), *(F.col(k).cast("string") for k in keys))).cast("boolean")
    checked = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.when(fine, F.lit(True)).otherwise(lost).alias("_fine")).where("_fine")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return draws.join(checked, same, "left_semi")


def validation_summary(draws: DataFrame, point: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """Paired intervals of improvement by model, baseline and comparison.

    With `expected`, every combination must have all replicates. `point` (model, baseline, comparison, improvement,
    percent_improvement) is put beside its interval; one without an interval is an error.
    """
    from duelgrid.operators.ranking import with_intervals

    if expected is not None:
        draws = complete_draws(draws.withColumn("_of", F.when(F.col("baseline") == "fixed_grid", F.col("strength"))), ["model", "baseline", "_of"], expected).drop("_of")
    found = _improvement_intervals(draws)
    return found if point is None else with_intervals(point, found, ["model", "baseline", "comparison"])


def _improvement_intervals(draws: DataFrame) -> DataFrame:
    from duelgrid.operators.baselines import label_of

    comparison = F.when(F.col("baseline") == "training_cv_selected", F.col("baseline")).otherwise(label_of(F.col("strength")))
    return draws.groupBy("model", "baseline", comparison.alias("comparison")).agg(
        F.count(F.lit(1)).alias("n_boot"),
        *(a.alias(f"{c}_{n}") for c in ("improvement", "percent_improvement") for n, a in (("mean", F.avg(c)), ("q025", F.percentile(c, F.lit(0.025))), ("q975", F.percentile(c, F.lit(0.975))))),
    )


def selected_frequencies(draws: DataFrame, expected: int) -> DataFrame:
    chosen = draws.where("baseline = 'training_cv_selected'").groupBy("model", "strength").agg(F.count(F.lit(1)).alias("draws"))
    return chosen.select("model", "strength", "draws", (F.col("draws") / expected).alias("frequency"))
