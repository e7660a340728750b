"""Rule sets of the matchup and play tables: one aggregation pass counts the violations of every row rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.params import CLASSES


def _long(counts: DataFrame) -> DataFrame:
    """One row a rule from one row of counts."""
    pairs = F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations")) for c in counts.columns))
    return counts.select(F.explode(pairs).alias("r")).select("r.*")


def _count(holds: Column) -> Column:
    """Rows where a rule doesn't hold; a null outcome counts as a violation."""
    return F.count_if(~F.coalesce(holds, F.lit(False)))


def matchup_quality(contests: DataFrame) -> DataFrame:
    """(rule, violations) of the matchup rules."""
    c = F.col
    final = c("severity_outcome").isNotNull()
    expected = F.when(c("sack_credit") > 0, "sack").when(c("strict_recorded_pressure") == 1, "pressure").when(c("win_target") == 1, "win").otherwise("loss")
    identity = [c(n).isNotNull() for n in ("game_id", "play_id", "game_index", "week", "kickoff", "rusher_name", "rusher_key", "blocker_keys")]
    whole = identity[0]
    for part in identity[1:]:
        whole = whole & part
    members = (F.size("blocker_keys") > 0) & (F.size(F.array_distinct("blocker_keys")) == F.size("blocker_keys")) & ~F.exists("blocker_keys", lambda k: k.isNull() | (k == "id:"))
    rows = contests.agg(
        _count(whole).alias("V02_identity"),
        _count(members).alias("V03_members"),
        _count(F.size("blocker_names") == F.size("blocker_keys")).alias("V04_names"),
        _count(c("group_size") == F.size("blocker_keys")).alias("V05_group_size"),
        _count((F.size("blocker_rated_ol") == c("group_size")) & ~F.exists("blocker_rated_ol", lambda f: ~f.isin(0, 1))).alias("V06_flags"),
        _count(c("double_team").isin(0, 1) & c("double_team_unknown").isin(0, 1) & (c("double_team") + c("double_team_unknown") <= 1)).alias("V07_help"),
        _count((c("win_target").isNull() | c("win_target").isin(0.0, 1.0)) & (~final | c("severity_outcome").isin(*CLASSES))).alias("V08_outcomes"),
        _count(c("early_model_eligible").isin(0, 1)).alias("V09_eligible_flag"),
        _count((c("early_model_eligible") == 0) | c("win_target").isNotNull()).alias("V10_eligible_graded"),
        _count(c("strict_recorded_pressure").isin(0, 1)).alias("V11_pressure_flag"),
        _count(~final | (c("severity_outcome") == expected)).alias("V12_category"),
        _count(~final | c("win_target").isNotNull()).alias("V13_final_graded"),
        _count((c("sack_credit") >= 0) & (c("sack_credit") <= 1) & (~final | (c("severity_outcome") != "sack") | (c("sack_credit") > 0))).alias("V14_credit"),
    )
    repeated = contests.groupBy("game_id", "play_id", "rusher_key").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("V15_unique"))
    games = contests.select("game_id", "game_index", "week", "kickoff").distinct()
    # a game table is as long as there are games; the one ordering window runs on it alone
    previous = F.lag("kickoff").over(Window.orderBy("game_index"))
    chronology = games.select("*", F.count(F.lit(1)).over(Window.partitionBy("game_id")).alias("_g"), F.count(F.lit(1)).over(Window.partitionBy("game_index")).alias("_i"), previous.alias("_before"))
    chronology = chronology.agg(F.count_if((c("_g") > 1) | (c("_i") > 1)).alias("V16_chronology"), F.count_if((c("_before") > c("kickoff")) | ~c("week").between(1, 18)).alias("V17_order"))
    return _long(rows.crossJoin(repeated).crossJoin(chronology))


def play_quality(plays: DataFrame, pool: DataFrame, pool_sizes: tuple[int, int] | None = None) -> DataFrame:
    """(rule, violations) of the play rules.

    `pool_sizes` are the games that the pool must have in the training and the hold-out weeks; without it both must have one.
    """
    c = F.col
    near = lambda a, b: F.abs(a - b) <= 1e-8
    counts = ("N_W", "N_P", "N_H", "N_S", "B", "U", "E", "P_B", "H_B", "S_B", "P_A", "H_A", "S_A", "K_B")
    context = ("epa", "ydstogo", "yardline_100", "half_seconds_remaining", "score_differential")
    real = F.lit(True)
    for name in context:
        real = real & c(name).isNotNull() & ~F.isnan(name)
    least = F.least(*(c(n) for n in counts))
    whole = F.lit(True)
    for name in ("N_W", "P_B", "K_B", "B", "P_A"):
        whole = whole & near(c(name), F.round(name))
    eligible = c("eligible_primary")
    rows = plays.agg(
        _count(c("game_id").isNotNull() & c("play_id").isNotNull() & c("week").isNotNull()).alias("E02_identity"),
        _count(c("week").between(1, 18)).alias("E04_week"),
        _count(c("split") == F.when(c("week") <= 15, "train").otherwise("test")).alias("E05_split"),
        _count((c("early_protection_participants") >= 0) & (c("early_protection_ungraded_actors") >= 0)).alias("E06_counts"),
        _count((c("early_protection_ungraded_actors") <= c("early_protection_participants")) & (c("early_protection_complete") == (c("early_protection_ungraded_actors") == 0))).alias("E07_complete"),
        _count(~eligible | c("early_protection_complete")).alias("E08_eligible_complete"),
        _count(~eligible | c("accepted_penalty").isNotNull()).alias("E09_penalty"),
        _count(eligible | c("exclusion_reason").isNotNull()).alias("E10_reason"),
        _count(real).alias("E14_context"),
        _count((c("N_H") == 0) & (c("H_B") == 0) & (c("H_A") == 0)).alias("E15_hits"),
        _count(c("U") == 0).alias("E16_unknown"),
        _count(c("B") == c("early_protection_participants")).alias("E17_participants"),
        _count(c("down").between(1, 4) & (c("qtr") >= 1) & (c("ydstogo") >= 0)).alias("E18_down"),
        _count(c("defteam").isNotNull()).alias("E19_defence"),
        _count(least >= -1e-9).alias("E20_sign"),
        _count(whole).alias("E21_integers"),
        _count(c("N_S").isin(0.0, 1.0)).alias("E22_sack"),
        _count(near(c("N_P"), c("P_B") + c("P_A")) & near(c("N_H"), c("H_B") + c("H_A")) & near(c("N_S"), c("S_B") + c("S_A")) & near(c("E"), c("K_B") - c("S_B"))).alias("E23_sums"),
        _count(c("B") - c("N_W") - c("P_B") - c("H_B") - c("K_B") - c("U") >= -1e-8).alias("E24_losses"),
    )
    repeated = plays.groupBy("game_id", "play_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("E03_unique"))
    games = pool.groupBy("game_id").agg(F.count(F.lit(1)).alias("_n"), F.max("week").alias("_week"))
    in_train, in_test = F.count_if(c("_week") <= 15), F.count_if(c("_week") > 15)
    off = F.abs(in_train - pool_sizes[0]) + F.abs(in_test - pool_sizes[1]) if pool_sizes else (in_train == 0).cast("long") + (in_test == 0).cast("long")
    pools = games.agg(F.count_if((c("_n") > 1) | ~c("_week").between(1, 18)).alias("E11_pool"), off.alias("E12_pool_size"))
    parts = plays.agg(*((F.count_if(eligible & (c("split") == part)) == 0).cast("long").alias(part) for part in ("train", "test"))).select((c("train") + c("test")).alias("E25_splits"))
    placed = plays.select("game_id", "week").join(games, "game_id", "left").agg(_count(c("week") == c("_week")).alias("E13_pool_week"))
    return _long(rows.crossJoin(repeated).crossJoin(pools).crossJoin(placed).crossJoin(parts))


def folds_quality(folds: DataFrame, contests: DataFrame, k: int) -> DataFrame:
    """(rule, violations) of a fold table: no game twice, labels 1..k all used and no others, every game of the contests placed."""
    sizes = folds.groupBy("game_id").agg(F.count(F.lit(1)).alias("_n"))
    labels = folds.select("fold").distinct()
    wrong = labels.where(~F.coalesce(F.col("fold").between(1, k), F.lit(False))).agg(F.count(F.lit(1)).alias("_wrong"))
    used = labels.where(F.col("fold").between(1, k)).agg((F.lit(k) - F.count(F.lit(1))).alias("_unused"))
    lost = contests.select("game_id").distinct().join(sizes, "game_id", "left_anti").agg(F.count(F.lit(1)).alias("F03_games"))
    repeated = sizes.agg(F.count_if(F.col("_n") > 1).alias("F01_unique"))
    return _long(repeated.crossJoin(wrong.crossJoin(used).select((F.col("_wrong") + F.col("_unused")).alias("F02_labels"))).crossJoin(lost))


def reference_quality(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """(rule, violations) of a reference population: weights finite and positive, adding up to 1 within 1e-10 by `keys`."""
    weight = F.col("weight")
    good = weight.isNotNull() & ~F.isnan(weight) & (weight < float("inf")) & (weight > 0)
    # added up exactly: millions of equal doubles drift by more than the bound, each rounded the same way
    exact = weight.try_cast("decimal(28,24)")
    sums = contexts.groupBy(*keys).agg(F.sum(exact).alias("_sum"), F.count_if(weight.isNotNull() & exact.isNull()).alias("_outside"), F.count_if(~F.coalesce(good, F.lit(False))).alias("_bad"))
    whole = (F.abs(F.col("_sum") - 1) <= F.lit("0.0000000001").cast("decimal(11,10)")) & (F.col("_outside") == 0)
    return _long(sums.agg(F.coalesce(F.sum("_bad"), F.lit(0)).alias("R01_positive"), _count(whole).alias("R02_sum")))


def result_quality(scores: DataFrame, draws: DataFrame, chances: DataFrame, losses: DataFrame, replicates: int) -> DataFrame:
    """(rule, violations) of results.

    `scores` (model, role, player_key, method, score_type): no key twice. `draws` (and replicate_id, present_in_draw):
    replicates 1..n, every score in each of them, the same presence in all score types of a player. `chances` (class
    probabilities as `p_*`): finite, adding up to 1. `losses` (replicate_id, model, strength, test_rows): the same rows at
    all strengths, so that differences are paired.
    """
    c = F.col
    keys = scores.groupBy("model", "role", "player_key", "method", "score_type").agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(c("_n") > 1).alias("X01_score_key"))
    numbers = draws.select("replicate_id").distinct().agg((F.lit(replicates) - F.count_if(c("replicate_id").between(1, replicates)) + F.count_if(~c("replicate_id").between(1, replicates))).alias("X02_replicates"))
    held = draws.groupBy("model", "score_type", "role", "player_key").agg(F.countDistinct("replicate_id").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    grid = held.agg(F.count_if((c("_n") != replicates) | (c("_rows") != replicates)).alias("X03_grid"))
    presence = draws.groupBy("replicate_id", "model", "role", "player_key").agg((F.min("present_in_draw") != F.max("present_in_draw")).alias("_odd")).agg(F.count_if("_odd").alias("X04_presence"))
    parts = [c(n) for n in chances.columns if n.startswith("p_")]
    total = sum(parts, F.lit(0.0))
    sums = chances.agg(_count(F.abs(total - 1) <= 1e-9).alias("X05_probabilities"))
    paired = losses.groupBy("replicate_id", "model").agg((F.min("test_rows") != F.max("test_rows")).alias("_odd")).agg(F.count_if("_odd").alias("X06_paired"))
    return _long(keys.crossJoin(numbers).crossJoin(grid).crossJoin(presence).crossJoin(sums).crossJoin(paired))


def enforce(violations: DataFrame) -> None:
    """Raise with the names of all violated rules."""
    bad = violations.where("violations > 0").orderBy("rule").collect()
    if bad:
        raise ValueError("Violated rules: " + ", ".join(f"{r['rule']} ({r['violations']})" for r in bad))
