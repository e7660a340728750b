"""Design rows as triplets (row, term, value), coefficient centring and linear prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.params import UNKNOWN_QB

COUNTS = ("N_W", "N_P", "N_S", "B", "E")
CONTEXT = ("log_ydstogo", "yardline_100", "half_seconds_remaining", "score_differential")


def _triplets(rows: DataFrame, keys: list[str], entries: Column) -> DataFrame:
    return rows.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.term", "_e.value")


def _entry(term: Column, value: Column) -> Column:
    return F.struct(term.alias("term"), value.cast("double").alias("value"))


def matchup_design(contests: DataFrame, keys: list[str], roles: tuple[str, ...] = ("rusher", "blocker")) -> DataFrame:
    """Focal player 1, each opponent -1 / group size, and the help flags; zero entries are left out."""
    size = F.size("blocker_keys")
    parts = []
    if "rusher" in roles:
        parts.append(F.array(_entry(F.concat(F.lit("rusher::"), "rusher_key"), F.lit(1.0))))
    if "blocker" in roles:
        parts.append(F.transform("blocker_keys", lambda k: _entry(F.concat(F.lit("blocker::"), k), -1.0 / size)))
    for flag in ("double_team", "double_team_unknown"):
        parts.append(F.array(_entry(F.lit(flag), F.col(flag))))
    return _triplets(contests, keys, F.filter(F.concat(*parts), lambda e: e["value"] != 0))


def quarterback() -> Column:
    return F.when(F.coalesce(F.col("quarterback_id"), F.lit("")) == "", UNKNOWN_QB).otherwise(F.col("quarterback_id"))


def context_values() -> dict[str, Column]:
    return {"log_ydstogo": F.log1p("ydstogo"), **{c: F.col(c) for c in CONTEXT[1:]}}


def play_basis(train: DataFrame) -> DataFrame:
    """(term, center, scale): mean and sample deviation of the context; a deviation of 0 counts as 1."""
    values = context_values()
    row = train.agg(*(F.avg(v).alias(f"{t}_m") for t, v in values.items()), *(F.stddev_samp(v).alias(f"{t}_s") for t, v in values.items()))
    scale = lambda t: F.when(F.coalesce(F.col(f"{t}_s"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"{t}_s"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"{t}_m").alias("center"), scale(t).alias("scale")) for t in values))).alias("b")).select("b.*")


def play_levels(train: DataFrame) -> DataFrame:
    """(kind, level) of the fixed effects seen in training, the unknown quarterback always among them."""
    seen = train.select(F.explode(F.array(F.struct(F.lit("QB").alias("kind"), quarterback().alias("level")), F.struct(F.lit("DEF").alias("kind"), F.col("defteam").alias("level")))).alias("l")).select("l.*").distinct()
    unknown = train.sparkSession.createDataFrame([("QB", UNKNOWN_QB)], "kind string, level string")
    return seen.unionByName(unknown).distinct()


def play_design(plays: DataFrame, train: DataFrame, keys: list[str], kind: str = "primary") -> DataFrame:
    """Intercept, counts (none for `context`; protected counts for `protected`), standardised context and fixed effects.

    Levels not seen in training have no entry. Zero entries are left out. The basis is one row and broadcast.
    """
    return _triplets(play_rows(plays, train, kind), keys, F.col("x"))


def play_rows(plays: DataFrame, train: DataFrame, kind: str = "primary") -> DataFrame:
    """The plays with the entries of `play_design` as an array `x` of (term, value)."""
    basis = play_basis(train).groupBy().pivot("term", list(CONTEXT)).agg(F.first("center").alias("m"), F.first("scale").alias("s"))
    values = context_values()
    entries = [_entry(F.lit("(Intercept)"), F.lit(1.0))]
    if kind != "context":
        source = {"N_P": "P_B", "N_S": "S_B"} if kind == "protected" else {}
        entries += [_entry(F.lit(c), F.col(source.get(c, c))) for c in COUNTS]
        if kind == "protected":
            entries += [_entry(F.lit(c), F.col(c)) for c in ("P_A", "S_A")]
    entries += [_entry(F.lit(t), (values[t] - F.col(f"{t}_m")) / F.col(f"{t}_s")) for t in CONTEXT]
    entries += [_entry(F.lit(f"down_{d}"), F.col("down") == d) for d in (2, 3, 4)]
    entries += [_entry(F.lit("half_2"), F.col("qtr").isin(3, 4)), _entry(F.lit("overtime"), F.col("qtr") >= 5)]
    levels = play_levels(train)
    seen = lambda k, c: levels.where(F.col("kind") == k).select(F.col("level").alias(c))
    rows = plays.crossJoin(F.broadcast(basis)).withColumn("_qb", quarterback())
    rows = rows.join(seen("QB", "_qb_level"), F.col("_qb") == F.col("_qb_level"), "left").join(seen("DEF", "_def_level"), F.col("defteam") == F.col("_def_level"), "left")
    entries += [_entry(F.concat(F.lit("QB::"), "_qb_level"), F.when(F.col("_qb_level").isNotNull(), 1).otherwise(0))]
    entries += [_entry(F.concat(F.lit("DEF::"), "_def_level"), F.when(F.col("_def_level").isNotNull(), 1).otherwise(0))]
    return rows.withColumn("x", F.filter(F.array(*entries), lambda e: e["value"] != 0))


def center_coefficients(coefficients: DataFrame) -> DataFrame:
    """Centre (model, term, cls, coefficient): classes of a term to mean 0 (several classes), roles to mean 0 in a class.

    The intercept takes what the roles lose, so predictions don't change. The table is as long as the vocabulary.
    """
    from pyspark.sql import Window

    classes = F.count(F.lit(1)).over(Window.partitionBy("model", "term"))
    across = F.avg("coefficient").over(Window.partitionBy("model", "term"))
    rows = coefficients.select("model", "term", "cls", F.when(classes > 1, F.col("coefficient") - across).otherwise(F.col("coefficient")).alias("coefficient"))
    role = F.when(F.col("term").startswith("rusher::"), "rusher").when(F.col("term").startswith("blocker::"), "blocker")
    means = rows.where(role.isNotNull()).groupBy("model", "cls").agg(F.avg(F.when(role == "rusher", F.col("coefficient"))).alias("_r"), F.avg(F.when(role == "blocker", F.col("coefficient"))).alias("_b"))
    met = rows.join(F.broadcast(means), ["model", "cls"], "left").fillna({"_r": 0.0, "_b": 0.0})
    shift = F.when(role == "rusher", -F.col("_r")).when(role == "blocker", -F.col("_b")).when(F.col("term") == "(Intercept)", F.col("_r") - F.col("_b")).otherwise(0.0)
    return met.select("model", "term", "cls", (F.col("coefficient") + shift).alias("coefficient"))


def linear_predictor(design: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of value x coefficient by row and class, plus the intercept where the design has none."""
    terms = design.join(coefficients, "term").groupBy(*keys, "cls").agg(F.sum(F.col("value") * F.col("coefficient")).alias("_eta"))
    constant = coefficients.where("term = '(Intercept)'").select("cls", F.col("coefficient").alias("_c"))
    return terms.join(F.broadcast(constant), "cls").select(*keys, "cls", (F.col("_eta") + F.col("_c")).alias("eta"))
