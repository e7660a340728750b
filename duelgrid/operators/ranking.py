"""Cohort ranks, rank agreement, honours alignment and rank uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.functions.scalars import name_key
from duelgrid.functions.stats import auc, average_rank, finite, guarded_correlation, guarded_percentile, top_credit
from duelgrid.params import THRESHOLDS
from duelgrid.sources.stage import kept

COHORT = ["model", "role", "min_interactions"]


def add_honours(players: DataFrame, honours: DataFrame) -> DataFrame:
    """Labels by role and normalised name; a name held by several players is ambiguous and its labels are null."""
    named = players.withColumn("name_norm", name_key(F.col("player_name")))
    identities = named.select("role", "name_norm", "player_key").distinct().groupBy("role", "name_norm").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    known = honours.select("role", name_key(F.col("name")).alias("name_norm"), "first_team").groupBy("role", "name_norm").agg(F.max("first_team").alias("first_team"))
    met = named.join(identities, ["role", "name_norm"]).join(known, ["role", "name_norm"], "left")
    found = F.col("first_team").isNotNull()
    return met.select(
        *players.columns,
        "ambiguous",
        F.when(~found, "unmatched").when(F.col("ambiguous"), "ambiguous_name").otherwise("matched").alias("match_status"),
        F.when(~found, False).when(~F.col("ambiguous"), F.col("first_team")).alias("is_first_team"),
        F.when(~found, False).when(~F.col("ambiguous"), True).alias("is_any_team"),
    )


def rank_cohorts(scores: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Ranks inside exposure cohorts: over all eligible players, and over those comparable in every method.

    A method is `method:score_type`. Eligible: exposure of at least the threshold. Comparable: eligible, with a finite
    score in every method of the model and role. Top-10 credit is over the eligible ones. A player whose methods tell
    different exposures is an error.

    Scores are written once, as they are read three times: by method, by player and for the ranks.
    """
    scores = kept(scores, "cohort-scores").withColumn("comparison_id", F.concat_ws(":", "method", "score_type"))
    everything = scores.groupBy("model", "role").agg(F.countDistinct("comparison_id").alias("_methods"))
    players = scores.groupBy("model", "role", "player_key").agg(F.countDistinct(F.when(finite(F.col("score")), F.col("comparison_id"))).alias("_finite"), F.min("role_interactions").alias("_least"), F.max("role_interactions").alias("_most"))
    differ = F.raise_error(F.concat_ws(" ", F.lit("Exposures differ of"), "model", "role", "player_key")).cast("boolean")
    complete = F.when(F.col("_least").eqNullSafe(F.col("_most")), F.col("_finite") == F.col("_methods")).otherwise(differ)
    players = players.join(F.broadcast(everything), ["model", "role"]).select("model", "role", "player_key", complete.alias("_complete"))
    limits = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("min_interactions")
    rows = scores.join(players, ["model", "role", "player_key"]).select("*", limits).where(F.col("role_interactions") >= F.col("min_interactions"))
    cohort = [*COHORT, "comparison_id"]
    whole = Window.partitionBy(*cohort)
    comparable = F.when(F.col("_complete"), F.col("score"))
    return rows.select(
        *scores.columns,
        "min_interactions",
        F.col("_complete").alias("comparison_eligible"),
        F.count(F.lit(1)).over(whole).alias("cohort_n_observed"),
        F.count_if(F.col("_complete")).over(whole).alias("cohort_n_comparable"),
        average_rank(F.col("score"), cohort).alias("rank_by_role"),
        average_rank(comparable, cohort).alias("comparison_rank"),
        top_credit(F.col("score"), cohort).alias("top10_credit"),
    )


def rank_pairs(ranked: DataFrame) -> DataFrame:
    """Every unordered pair of methods of each comparable player with both ranks and their difference."""
    rows = ranked.where("comparison_eligible").select(*COHORT, "player_key", "comparison_id", "score", "comparison_rank", "role_interactions")
    # a player's few methods meet inside one row; no self-join
    held = rows.groupBy(*COHORT, "player_key").agg(F.array_sort(F.collect_list(F.struct("comparison_id", "score", "comparison_rank"))).alias("m"), F.max("role_interactions").alias("role_interactions"))
    first = held.select("*", F.posexplode("m").alias("_i", "_a"))
    both = first.select(*COHORT, "player_key", "role_interactions", "_a", F.explode(F.slice("m", F.col("_i") + 2, F.size("m"))).alias("_b"))
    return both.select(
        *COHORT,
        F.col("_a.comparison_id").alias("method_a"),
        F.col("_b.comparison_id").alias("method_b"),
        "player_key",
        "role_interactions",
        F.col("_a.comparison_rank").alias("rank_a"),
        F.col("_b.comparison_rank").alias("rank_b"),
        (F.col("_a.comparison_rank") - F.col("_b.comparison_rank")).alias("rank_improvement_b"),
    )


def rank_correlations(pairs: DataFrame) -> DataFrame:
    """Spearman's correlation (of the average ranks) and mean absolute change by pair of methods."""
    return pairs.groupBy(*COHORT, "method_a", "method_b").agg(
        F.count(F.lit(1)).alias("n_players"), guarded_correlation(F.col("rank_a"), F.col("rank_b")).alias("spearman"), F.avg(F.abs("rank_improvement_b")).alias("mean_absolute_rank_change")
    )


def honours_metrics(ranked: DataFrame, accolades: tuple[str, ...] = ("first_team", "any_team")) -> DataFrame:
    """Positives, expected positives among the top 10 and AUC by cohort, method and accolade, over labelled players."""
    labels = F.array(*(F.struct(F.lit(a).alias("accolade"), F.col(f"is_{a}").alias("label")) for a in accolades))
    rows = ranked.where("comparison_eligible").select(*COHORT, "comparison_id", "score", F.explode(labels).alias("_l")).select("*", "_l.*").drop("_l")
    key = [*COHORT, "comparison_id", "accolade"]
    known = F.when(F.col("label").isNotNull(), F.col("score"))
    rows = rows.select("*", average_rank(known, key, True).alias("_up"), top_credit(known, key).alias("_credit"))
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_players"),
        F.count_if(F.col("label")).alias("n_positive"),
        F.count_if(F.col("label").isNull()).alias("n_unresolved"),
        F.sum(F.when(F.col("label"), F.col("_credit")).otherwise(0.0)).alias("positives_among_top10"),
        auc(F.col("label"), F.col("_up")).alias("auc"),
    )


def rank_agreement(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Spearman, mean, median and largest rank change and shared top-10 credit of two score columns by `keys`."""
    ranked = rows.select(
        *keys,
        average_rank(F.col(a), keys).alias("_ra"),
        average_rank(F.col(b), keys).alias("_rb"),
        F.least(top_credit(F.col(a), keys), top_credit(F.col(b), keys)).alias("_both"),
    )
    change = F.abs(F.col("_ra") - F.col("_rb"))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_players"),
        guarded_correlation(F.col("_ra"), F.col("_rb")).alias("spearman"),
        F.avg(change).alias("mean_absolute_rank_change"),
        F.percentile(change, F.lit(0.5)).alias("median_absolute_rank_change"),
        F.max(change).alias("max_absolute_rank_change"),
        F.sum("_both").alias("top10_overlap_credit"),
    )


def rank_views(players: DataFrame, methods: list[str], exposures: list[str], thresholds: tuple[int, ...] = THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """(ranks, pair statistics) over cohorts where every method is finite and every exposure positive and large enough."""
    whole = F.lit(True)
    for m in methods:
        whole = whole & finite(F.col(m))
    for e in exposures:
        whole = whole & (F.col(e) > 0)
    least = F.least(*(F.col(e) for e in exposures)) if len(exposures) > 1 else F.col(exposures[0])
    limits = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("min_interactions")
    rows = players.where(whole).select("*", limits).where(least >= F.col("min_interactions"))
    long = rows.select("role", "min_interactions", "player_key", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods))).alias("_m")).select("role", "min_interactions", "player_key", "_m.*")
    key = ["role", "min_interactions", "method"]
    ranks = long.select("*", average_rank(F.col("score"), key).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("n_players"))
    couples = [(a, b) for i, a in enumerate(sorted(methods)) for b in sorted(methods)[i + 1 :]]
    both = F.explode(F.array(*(F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.col(a).alias("score_a"), F.col(b).alias("score_b")) for a, b in couples)))
    paired = rows.select("role", "min_interactions", both.alias("_c")).select("role", "min_interactions", "_c.*")
    return ranks, rank_agreement(paired, ["role", "min_interactions", "method_a", "method_b"], "score_a", "score_b")


def view_honours(ranks: DataFrame, labels: DataFrame, rated: DataFrame) -> DataFrame:
    """Honours metrics of every method of `rank_views`; of the opponents only those that are rated count.

    `labels` has role, player_key, is_first_team and is_any_team; `rated` the player_key of rated opponents.
    """
    held = ranks.join(labels.select("role", "player_key", "is_first_team", "is_any_team"), ["role", "player_key"])
    held = held.join(rated.select("player_key", F.lit(True).alias("_rated")), "player_key", "left").where((F.col("role") == "Rusher") | F.col("_rated"))
    rows = held.select(F.lit("win").alias("model"), "role", "min_interactions", "player_key", F.col("method").alias("comparison_id"), "score", F.lit(True).alias("comparison_eligible"), "is_first_team", "is_any_team")
    return honours_metrics(rows).drop("model")


def with_intervals(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Point rows with the columns of their interval; a point without an interval is an error when it is read."""
    met = points.join(intervals.withColumn("_found", F.lit(True)), keys, "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("No interval for"), *(F.col(k).cast("string") for k in keys))).cast("boolean")
    return met.withColumn("_found", F.when(F.col("_found").isNull(), lost).otherwise(F.col("_found"))).where("_found").drop("_found")


def scoped_rank_intervals(draws: DataFrame, ranked: DataFrame, method: str) -> DataFrame:
    """Ranks of each draw inside each fixed cohort of `method`: their quantiles and the probability of the top 10.

    `draws` has model, score_type, role, player_key, replicate_id and score.
    """
    cohort = ranked.where((F.col("method") == method) & F.col("comparison_eligible")).select("model", "score_type", "role", "player_key", "min_interactions", "comparison_rank")
    rows = draws.join(cohort, ["model", "score_type", "role", "player_key"])
    key = ["model", "score_type", "role", "min_interactions", "replicate_id"]
    all_finite = F.count_if(~finite(F.col("score"))).over(Window.partitionBy(*key)) == 0
    rows = rows.select("*", average_rank(F.col("score"), key).alias("_rank"), F.when(all_finite, top_credit(F.col("score"), key)).alias("_credit"))
    return rows.groupBy("model", "score_type", "role", "min_interactions", "player_key").agg(
        F.max("comparison_rank").alias("comparison_rank"),
        F.count(F.lit(1)).alias("n_draws"),
        guarded_percentile(F.col("_rank"), 0.025).alias("rank_q025"),
        guarded_percentile(F.col("_rank"), 0.975).alias("rank_q975"),
        F.when(F.count_if(F.col("_credit").isNull()) == 0, F.avg("_credit")).alias("top10_probability"),
    )


def paired_rank_uncertainty(pairs: DataFrame, draws: DataFrame, type_a: str, type_b: str, method_a: str, method_b: str) -> DataFrame:
    """Per-draw rank difference of two score types inside the fixed cohorts of a pair of methods (severity model).

    A player of a cohort needs one finite score of each type in every draw, with the same presence in both: else the
    result is an error when it is read.
    """
    point = pairs.where((F.col("model") == "severity") & (F.col("method_a") == method_a) & (F.col("method_b") == method_b)).select("role", "min_interactions", "player_key", (F.col("rank_a") - F.col("rank_b")).alias("point"))
    wide = draws.where("model = 'severity'").groupBy("role", "player_key", "replicate_id").agg(
        F.max(F.when(F.col("score_type") == type_a, F.col("score"))).alias("a"),
        F.max(F.when(F.col("score_type") == type_b, F.col("score"))).alias("b"),
        F.max("present_in_draw").alias("present"),
        *(F.count_if(F.col("score_type") == t).alias(f"_n{i}") for i, t in enumerate((type_a, type_b))),
        *(F.max(F.when(F.col("score_type") == t, F.col("present_in_draw"))).alias(f"_p{i}") for i, t in enumerate((type_a, type_b))),
    )
    key = ["role", "min_interactions", "replicate_id"]
    ids = draws.where("model = 'severity'").select("replicate_id").distinct()
    rows = point.crossJoin(F.broadcast(ids)).join(wide, ["role", "player_key", "replicate_id"], "left")
    fine = finite(F.col("a")) & finite(F.col("b")) & (F.col("_n0") == 1) & (F.col("_n1") == 1) & F.col("_p0").eqNullSafe(F.col("_p1")) & F.col("_p0").isNotNull()
    lost = F.raise_error(F.concat_ws(" ", F.lit("Missing, repeated or invalid paired scores of"), "role", "player_key", F.lit("in draw"), F.col("replicate_id").cast("string"))).cast("boolean")
    rows = rows.where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(lost))
    rows = rows.select("*", (average_rank(F.col("a"), key) - average_rank(F.col("b"), key)).alias("delta"))
    share = lambda test: F.avg(test.cast("double"))
    return rows.groupBy("role", "min_interactions", "player_key").agg(
        F.max("point").alias("rank_delta_point"),
        F.avg("delta").alias("rank_delta_mean"),
        F.percentile("delta", F.lit(0.5)).alias("rank_delta_median"),
        F.percentile("delta", F.lit(0.025)).alias("rank_delta_q025"),
        F.percentile("delta", F.lit(0.975)).alias("rank_delta_q975"),
        share(F.col("delta") > 0).alias("positive_proportion"),
        share(F.col("delta") == 0).alias("zero_proportion"),
        share(F.col("delta") < 0).alias("negative_proportion"),
        share(F.signum("delta") == F.signum("point")).alias("same_sign_proportion"),
        share(F.col("present")).alias("presence_rate"),
        F.count(F.lit(1)).alias("n_draws"),
    )


def top_report(ranked: DataFrame, method: str, threshold: int = 200, k: int = 10) -> DataFrame:
    """The k best of each model, role and score type at a threshold."""
    order = Window.partitionBy("model", "role", "score_type").orderBy(F.col("score").desc_nulls_last(), "player_key")
    rows = ranked.where((F.col("method") == method) & (F.col("min_interactions") == threshold)).withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= k).select("model", "role", "score_type", "place", "player_key", "role_interactions", "score", "rank_by_role")
