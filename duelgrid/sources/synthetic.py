"""Seeded contests and plays with planted effects, from hash columns alone (tests and demonstrations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.operators.resample import hash_number

#: Planted effects of the plays: constant, then what each count adds to the value.
EFFECTS = {"(Intercept)": 0.3, "N_W": -0.12, "N_P": -0.35, "N_S": -2.0, "B": 0.08, "E": 0.1}


def _unit(*parts: Column) -> Column:
    return hash_number(*parts) / F.lit(4294967296.0)


def _pick(n: int, *parts: Column) -> Column:
    return F.pmod(hash_number(*parts), F.lit(n)).cast("int")


def synthetic_contests(spark: SparkSession, games: int = 20, rows: int = 60, seed: int = 17) -> DataFrame:
    """One or two opponents of 16, 12 focal players; the first plays are ungraded."""
    key, s = F.col("id"), F.lit(seed)
    base = spark.range(games * rows).withColumn("game_index", (F.floor(key / rows) + 1).cast("int"))
    a, b = _pick(16, s, F.lit("a"), key), _pick(15, s, F.lit("b"), key)
    second = F.when(b >= a, b + 1).otherwise(b)
    name = lambda n: F.concat(F.lit("id:"), (F.lit(201) + n).cast("string"))
    double = key % 3 == 1
    outcome = _unit(s, F.lit("y"), key)
    severity = F.when(outcome < 0.5, "loss").when(outcome < 0.75, "win").when(outcome < 0.9, "pressure").otherwise("sack")
    focal = (F.lit(101) + _pick(12, s, F.lit("r"), key)).cast("string")
    week = F.when(F.col("game_index") > games - 3, F.col("game_index") - games + 18).otherwise((F.col("game_index") - 1) % 15 + 1).cast("int")
    keys = F.when(double, F.array_sort(F.array(name(a), name(second)))).otherwise(F.array(name(a)))
    rows_ = base.select("*", severity.alias("s0"), keys.alias("blocker_keys"), focal.alias("rusher_id"), week.alias("week"), (key >= 5).alias("graded"), (key >= 10).alias("final"))
    win = F.when(F.col("s0") == "loss", 0.0).when(F.col("s0") == "win", 1.0).otherwise((_unit(s, F.lit("w"), key) < 0.5).cast("double"))
    return rows_.select(
        F.format_string("g%03d", "game_index").alias("game_id"), key.cast("string").alias("play_id"), "game_index", "week", F.timestamp_seconds(1_600_000_000 + F.col("game_index") * 86_400).alias("kickoff"),
        "rusher_id", F.concat(F.lit("Player "), "rusher_id").alias("rusher_name"), F.concat(F.lit("id:"), "rusher_id").alias("rusher_key"), "blocker_keys", F.col("blocker_keys").alias("blocker_names"),
        F.transform("blocker_keys", lambda k: (F.substring(k, 6, 1).cast("int") % 2 == 0).cast("int")).alias("blocker_rated_ol"), F.size("blocker_keys").alias("group_size"), double.cast("int").alias("double_team"), (key % 3 == 2).cast("int").alias("double_team_unknown"),
        F.when(F.col("graded"), win).alias("win_target"), F.when(F.col("final"), F.col("s0")).alias("severity_outcome"), F.when(F.col("s0") == "sack", F.when(key % 2 == 0, 1.0).otherwise(0.5)).otherwise(0.0).alias("sack_credit"),
        F.col("graded").cast("int").alias("early_model_eligible"), (F.col("s0") == "pressure").cast("int").alias("strict_recorded_pressure"),
    )


def synthetic_plays(spark: SparkSession, games: int = 40, rows: int = 60, seed: int = 43) -> DataFrame:
    """Plays whose value is EFFECTS x counts plus noise of deviation 0.02."""
    key, s = F.col("id"), F.lit(seed)
    base = spark.range(games * rows).withColumn("game", (F.floor(key / rows) + 1).cast("int"))
    count = lambda tag, n: _pick(n, s, F.lit(tag), key).cast("double")
    rows_ = base.select("*", (3 + count("B", 3)).alias("B"), count("N_W", 2).alias("N_W"), count("P_B", 2).alias("P_B"), count("P_A", 2).alias("P_A"), F.when(_unit(s, F.lit("k"), key) < 0.2, 1.0).otherwise(0.0).alias("K_B"))
    share = F.when(F.col("K_B") > 0, F.when(_unit(s, F.lit("o"), key) < 0.5, 0.5).otherwise(1.0)).otherwise(0.0)
    rows_ = rows_.select("*", share.alias("S_B"), F.when(F.col("K_B") > 0, 1 - share).otherwise(0.0).alias("S_A"))
    noise = sum((_unit(s, F.lit(f"n{i}"), key) for i in range(12)), F.lit(-6.0)) * 0.02
    counts = {"N_W": F.col("N_W"), "N_P": F.col("P_B") + F.col("P_A"), "N_S": F.col("K_B"), "B": F.col("B"), "E": F.col("K_B") - F.col("S_B")}
    value = sum((c * EFFECTS[n] for n, c in counts.items()), F.lit(EFFECTS["(Intercept)"])) + noise
    week = F.when(F.col("game") > games - 5, 16 + F.col("game") % 3).otherwise((F.col("game") - 1) % 15 + 1).cast("int")
    zero = F.lit(0.0)
    return rows_.select(
        F.format_string("g%03d", "game").alias("game_id"), key.cast("string").alias("play_id"), week.alias("week"), F.when(week <= 15, "train").otherwise("test").alias("split"), (F.col("game") != 2).alias("eligible_primary"),
        F.when(F.col("game") == 2, "excluded_game").alias("exclusion_reason"), value.alias("epa"), F.lit(True).alias("early_protection_complete"), F.col("B").cast("int").alias("early_protection_participants"), F.lit(0).alias("early_protection_ungraded_actors"),
        *(c.alias(n) for n, c in counts.items()), zero.alias("N_H"), zero.alias("U"), zero.alias("H_B"), zero.alias("H_A"), "P_B", "P_A", "S_B", "S_A", "K_B", (key % 12 == 0).alias("accepted_penalty"), (1 + _pick(4, s, F.lit("d"), key)).alias("down"), (1 + count("t", 15)).alias("ydstogo"),
        (1 + count("y", 99)).alias("yardline_100"), count("h", 1800).alias("half_seconds_remaining"), (count("c", 43) - 21).alias("score_differential"), (1 + _pick(5, s, F.lit("q"), key)).alias("qtr"),
        F.when(key % 50 != 0, F.concat(F.lit("q"), _pick(6, s, F.lit("b"), key).cast("string"))).alias("quarterback_id"), F.concat(F.lit("d"), _pick(4, s, F.lit("e"), key).cast("string")).alias("defteam"),
    )
