"""Cumulative weekly trajectories: each week sees all rows up to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.functions.stats import finite
from duelgrid.operators.contests import model_sample, observations, participations


def _cumulate(sums: DataFrame, keys: list[str], values: list[str], last_week: int) -> DataFrame:
    """Running totals over weeks 1..last_week from sums by week; players appear from their first week on.

    A game lies in one week, so distinct games by week add up. Totals are windows over per-week sums: at most
    `last_week` rows a player, whatever the number of contests.
    """
    first = sums.groupBy(*keys).agg(F.min("week").alias("_first"))
    grid = first.select(*keys, F.explode(F.sequence(F.col("_first"), F.lit(last_week))).alias("week"))
    upto = Window.partitionBy(*keys).orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = grid.join(sums, [*keys, "week"], "left")
    return met.select(*keys, "week", *(F.sum(F.coalesce(F.col(v), F.lit(0))).over(upto).alias(v) for v in values))


def weekly_raw(contests: DataFrame, copies: Column | None = None, last_week: int = 18) -> DataFrame:
    """Early interactions, games, wins and losses (plain and allocated) and rates of every player by week, cumulative."""
    times = copies if copies is not None else F.lit(1)
    rows = participations(model_sample(contests, "win").withColumn("_n", times).where("_n > 0"))
    win = F.col("win_target")
    sums = rows.groupBy("role", "player_key", "week").agg(
        F.sum("_n").alias("interactions"),
        F.countDistinct("game_id").alias("games"),
        F.sum(F.col("_n") * win).alias("wins"),
        F.sum(F.col("_n") * (1 - win)).alias("losses"),
        F.sum(F.col("_n") * F.col("mass") * win).alias("allocated_wins"),
        F.sum(F.col("_n") * F.col("mass") * (1 - win)).alias("allocated_losses"),
    )
    names = ["interactions", "games", "wins", "losses", "allocated_wins", "allocated_losses"]
    total = _cumulate(sums, ["role", "player_key"], names, last_week)
    focal = F.col("role") == "Rusher"
    allocated = F.col("allocated_wins") + F.col("allocated_losses")
    return total.select(
        "*",
        F.try_divide(F.when(focal, F.col("wins")).otherwise(F.col("losses")), F.col("interactions")).alias("raw_score"),
        F.try_divide(F.when(focal, F.col("allocated_wins")).otherwise(F.col("allocated_losses")), allocated).alias("allocated_raw_score"),
    )


def weekly_raw_draws(contests: DataFrame, draws: DataFrame, last_week: int = 18) -> DataFrame:
    """(replicate_id, role, player_key, week, raw_score): `weekly_raw`'s rates in every replicate, from sums by game."""
    rows = participations(model_sample(contests, "win"))
    by_game = rows.groupBy("role", "player_key", "week", "game_id").agg(F.count(F.lit(1)).alias("n"), F.sum("win_target").alias("w"))
    sums = by_game.join(draws.select("replicate_id", "game_id", "copies"), "game_id").groupBy("replicate_id", "role", "player_key", "week")
    sums = sums.agg(F.sum(F.col("n") * F.col("copies")).alias("interactions"), F.sum(F.col("w") * F.col("copies")).alias("wins"))
    total = _cumulate(sums, ["replicate_id", "role", "player_key"], ["interactions", "wins"], last_week)
    good = F.when(F.col("role") == "Rusher", F.col("wins")).otherwise(F.col("interactions") - F.col("wins"))
    return total.select("replicate_id", "role", "player_key", "week", F.try_divide(good, F.col("interactions")).alias("raw_score"))


def raw_bounds(values: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """(keys, raw_lower, raw_upper) of `raw_score`, where all expected draws have one."""
    whole = F.count_if(finite(F.col("raw_score"))) == expected
    return values.groupBy(*keys).agg(*(F.when(whole, F.percentile("raw_score", F.lit(q))).alias(n) for q, n in ((0.025, "raw_lower"), (0.975, "raw_upper"))))


def weekly_availability(contests: DataFrame, draws: DataFrame, last_week: int = 18) -> DataFrame:
    """Observed and sampled interactions by replicate, week, model, role and player, for players observed so far.

    `draws` has replicate_id, game_id and copies. Games are counted once; a replicate multiplies per-game sums, so no
    row is copied.
    """
    by_game = participations(observations(contests)).groupBy("model", "role", "player_key", "week", "game_id").agg(F.count(F.lit(1)).alias("n"))
    observed = _cumulate(by_game.groupBy("model", "role", "player_key", "week").agg(F.sum("n").alias("observed")), ["model", "role", "player_key"], ["observed"], last_week)
    sampled = by_game.join(draws, "game_id").groupBy("replicate_id", "model", "role", "player_key", "week").agg(F.sum(F.col("n") * F.col("copies")).alias("sampled"))
    sampled = _cumulate(sampled, ["replicate_id", "model", "role", "player_key"], ["sampled"], last_week)
    replicates = draws.select("replicate_id").distinct()
    met = observed.crossJoin(F.broadcast(replicates)).join(sampled, ["replicate_id", "model", "role", "player_key", "week"], "left").fillna({"sampled": 0})
    return met.select("replicate_id", "week", "model", "role", "player_key", F.col("observed").alias("observed_interactions"), F.col("sampled").alias("sampled_interactions"), (F.col("sampled") > 0).alias("present_in_draw"))


def weekly_intervals(values: DataFrame, keys: list[str], value: str, expected: int) -> DataFrame:
    """Interval of the draws by `keys`: complete only if all expected draws are finite; else conditional bounds alone."""
    ok = finite(F.col(value))
    known = F.when(ok, F.col(value))
    rows = values.groupBy(*keys).agg(F.count_if(ok).alias("defined_draws"), *(F.percentile(known, F.lit(q)).alias(n) for n, q in (("_low", 0.025), ("_mid", 0.5), ("_high", 0.975))))
    complete = F.col("defined_draws") == expected
    return rows.select(
        *keys,
        "defined_draws",
        (F.col("defined_draws") / expected).alias("defined_fraction"),
        F.when(complete, F.col("_low")).alias("lower"),
        F.when(complete, F.col("_mid")).alias("median"),
        F.when(complete, F.col("_high")).alias("upper"),
        F.col("_low").alias("conditional_lower"),
        F.col("_high").alias("conditional_upper"),
        F.when(complete, "complete").otherwise("nonestimable_draws_retained").alias("interval_status"),
    )


def weekly_summary(contests: DataFrame, drawn: DataFrame, values: DataFrame, availability: DataFrame, planned: int) -> DataFrame:
    """Intervals of the replicates' scores (replicate_id, week, model, role, player_key, score), bounds of their raw rates, and absences."""
    keys = ["week", "model", "role", "player_key"]
    grid = availability.select("replicate_id", *keys)
    rows = grid.join(values.select("replicate_id", *keys, "score"), ["replicate_id", *keys], "left")
    raw = grid.where("model = 'win'").join(weekly_raw_draws(contests, drawn), ["replicate_id", "week", "role", "player_key"], "left")
    intervals = weekly_intervals(rows, keys, "score", planned).join(raw_bounds(raw, keys, planned), keys, "left")
    return intervals.join(absence_counts(availability, planned), keys, "left")


def weekly_report(intervals: DataFrame) -> DataFrame:
    """Players, complete intervals and absent draws by week, model and role."""
    return intervals.groupBy("week", "model", "role").agg(F.count(F.lit(1)).alias("players"), F.count_if(F.col("interval_status") == "complete").alias("complete_intervals"))


def absence_counts(availability: DataFrame, planned: int) -> DataFrame:
    """Draws in which a player has no row up to a week, and draws planned, by week, model, role and player."""
    return availability.groupBy("week", "model", "role", "player_key").agg((F.lit(planned) - F.count_if("present_in_draw")).alias("absent_draws"), F.lit(planned).cast("long").alias("planned_draws"))


def exposed(scores: DataFrame, contests: DataFrame, week: int) -> DataFrame:
    """The scores of players with a row of the model up to a week, with their interactions."""
    seen = participations(observations(contests.where(F.col("week") <= week))).groupBy("model", "role", "player_key").agg(F.count(F.lit(1)).alias("interactions"))
    return scores.join(seen, ["model", "role", "player_key"])


def exposed_by_week(scores: DataFrame, contests: DataFrame, last_week: int = 18) -> DataFrame:
    """Scores (with `week`) of players with a row of the model up to their week, with their interactions so far."""
    sums = participations(observations(contests)).groupBy("model", "role", "player_key", "week").agg(F.count(F.lit(1)).alias("interactions"))
    seen = _cumulate(sums, ["model", "role", "player_key"], ["interactions"], last_week)
    return scores.join(seen, ["model", "role", "player_key", "week"])
