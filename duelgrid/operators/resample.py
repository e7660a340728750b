"""Game-cluster bootstrap and game folds by hash draws; replicates are a key, never a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_number(*parts: Column) -> Column:
    """The first 32 bits of the md5 of the parts joined by '-': the same in every engine and any schedule."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def game_folds(games: DataFrame, k: int, seed: int) -> DataFrame:
    """Balanced folds 1..k of the distinct games, in order of a seeded hash."""
    order = Window.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "game_id")), "game_id")
    numbered = games.select("game_id").distinct().withColumn("_n", F.row_number().over(order))
    return numbered.select("game_id", (F.pmod(F.col("_n") - 1, F.lit(k)) + 1).cast("int").alias("fold"))


def bootstrap_draws(pool: DataFrame, draws: int, seed: int, scope: str = "validation", last_train_week: int = 15) -> DataFrame:
    """(scope, replicate_id, game_id, copies): how often each replicate draws each game of the pool, with replacement.

    Scope validation draws the training and the test games apart, any other the whole pool. Games without rows are in
    the pool. Draw j of replicate r is a hash of (seed, scope, part, r, j): no order or partitioning changes it.
    """
    part = F.when(F.col("week") <= last_train_week, "train").otherwise("test") if scope == "validation" else F.lit("all")
    placed = pool.select("game_id", part.alias("part")).withColumn("_at", F.row_number().over(Window.partitionBy("part").orderBy("game_id")) - 1)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    replicates = pool.sparkSession.range(1, draws + 1).select(F.col("id").cast("int").alias("replicate_id"))
    tries = replicates.crossJoin(F.broadcast(sizes)).withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    picked = tries.select("part", "replicate_id", F.pmod(hash_number(F.lit(seed), F.lit(scope), F.col("part"), F.col("replicate_id"), F.col("_j")), F.col("_n")).cast("int").alias("_at"))
    counted = picked.groupBy("part", "replicate_id", "_at").agg(F.count(F.lit(1)).alias("copies"))
    return counted.join(placed, ["part", "_at"]).select(F.lit(scope).alias("scope"), "replicate_id", "game_id", "copies")
