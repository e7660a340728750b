"""Readers with declared schemas, sinks and resumable stage tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHUP_CSV = (
    "game_id string, play_id string, game_index int, week int, kickoff_utc string, rusher_id string, rusher_name string, blocker_ids string, "
    "blocker_names string, blocker_rated_ol string, double_team int, double_team_unknown int, complete_timing string, win_target double, "
    "severity_outcome string, sack_credit double, early_model_eligible int, strict_recorded_pressure int"
)
PLAY_COUNTS = ("N_W", "N_P", "N_H", "N_S", "B", "U", "E", "P_B", "H_B", "S_B", "P_A", "H_A", "S_A", "K_B")
PLAY_CSV = (
    "game_id string, play_id string, week int, split string, eligible_primary string, exclusion_reason string, epa double, "
    "early_protection_complete string, early_protection_participants int, early_protection_ungraded_actors int, "
    + ", ".join(f"{c} double" for c in PLAY_COUNTS)
    + ", accepted_penalty string, down int, ydstogo double, yardline_100 double, half_seconds_remaining double, score_differential double, qtr int, "
    "game_half string, quarterback_id string, defteam string"
)


def missing(value: str) -> Column:
    """The column as null where it is empty, NA or NaN."""
    return F.when(~F.col(value).isin("", "NA", "NaN"), F.col(value))


def truth(column: Column) -> Column:
    """1/TRUE/True/true and 0/FALSE/False/false; anything else is null."""
    return F.when(column.isin("1", "TRUE", "True", "true"), True).when(column.isin("0", "FALSE", "False", "false"), False)


def utc_time(text: Column) -> Column:
    """An ISO time with its offset (none or Z: UTC), whatever the session's time zone."""
    zone = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    whole = F.concat(F.substring(text, 1, 19), F.when(zone.isin("", "Z"), "+00:00").otherwise(zone))
    return F.coalesce(F.to_timestamp(whole, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.to_timestamp(whole, "yyyy-MM-dd'T'HH:mm:ssXX"))


def _read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read by name: every column as text first, then typed, so that NA texts become nulls and extra columns are ignored."""
    raw = spark.read.csv(path, header=True, escape='"', quote='"')
    wanted = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    absent = [name for name, _ in wanted if name not in raw.columns and name != "game_half"]
    if absent:
        raise ValueError("Missing columns: " + ", ".join(absent))
    return raw.select(*((missing(n) if n in raw.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted))


def read_matchups(spark: SparkSession, path: str) -> DataFrame:
    """The matchup CSV with its opponent arrays parsed and keys derived."""
    raw = _read_csv(spark, path, MATCHUP_CSV)
    ids = F.from_json("blocker_ids", "array<string>")
    return raw.select(
        "*",
        utc_time(F.col("kickoff_utc")).alias("kickoff"),
        F.concat(F.lit("id:"), "rusher_id").alias("rusher_key"),
        F.transform(ids, lambda i: F.concat(F.lit("id:"), i)).alias("blocker_keys"),
        F.from_json("blocker_names", "array<string>").alias("names"),
        F.from_json("blocker_rated_ol", "array<int>").alias("rated"),
        F.size(ids).alias("group_size"),
    ).drop("blocker_names", "blocker_rated_ol").withColumnsRenamed({"names": "blocker_names", "rated": "blocker_rated_ol"})


def read_plays(spark: SparkSession, path: str) -> DataFrame:
    raw = _read_csv(spark, path, PLAY_CSV)
    flags = {c: truth(F.col(c)) for c in ("eligible_primary", "early_protection_complete", "accepted_penalty")}
    return raw.withColumns(flags)


def read_play_data(spark: SparkSession, path: str, pool_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plays, pool, basis) of the play and pool CSVs: rules hold, plays lie in the pool's games, the basis is the training plays'."""
    from duelgrid.operators.design import play_basis
    from duelgrid.operators.quality import enforce, play_quality

    plays, pool = read_plays(spark, path), read_pool(spark, pool_path)
    enforce(play_quality(plays, pool))
    return plays, pool, play_basis(plays.where("eligible_primary and split = 'train'"))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(game_id, week) of the game pool's CSV."""
    return _read_csv(spark, path, "game_id string, week int")


def read_folds(spark: SparkSession, path: str, contests: DataFrame, k: int) -> DataFrame:
    """(game_id, fold) of a saved fold table (CSV), after its rules were checked against the contests."""
    from duelgrid.operators.quality import enforce, folds_quality

    folds = _read_csv(spark, path, "game_id string, fold int")
    enforce(folds_quality(folds, contests, k))
    return folds


def read_reference(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A saved reference population (Parquet with `weight`), after its weights were checked."""
    from duelgrid.operators.quality import enforce, reference_quality

    contexts = spark.read.parquet(path)
    enforce(reference_quality(contexts, keys))
    return contexts


#: Orders in which tables are given out.
CHRONOLOGICAL = {"contests": ["game_index", "play_id", "rusher_key"], "plays": ["week", "game_id", "play_id"]}


def json_text(column: Column) -> Column:
    """An array as JSON text in order of its elements."""
    return F.to_json(F.array_sort(column))


def group_apply(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """A function of pandas frames on every group of `keys`: the way out for what has no expression.

    A group must fit into one task; null keys are a group.
    """
    absent = [k for k in keys if k not in df.columns]
    if absent:
        raise ValueError("Missing columns: " + ", ".join(absent))
    return df.groupBy(*keys).applyInPandas(function, schema)


def content_hash(df: DataFrame) -> str:
    """Count and a sum of row hashes: equal for the same rows in any order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def write_table(df: DataFrame, folder: str, name: str, kind: str = "parquet") -> None:
    """Write a stage table; contests and plays in chronological order."""
    if name in CHRONOLOGICAL and all(c in df.columns for c in CHRONOLOGICAL[name]):
        df = df.orderBy(*CHRONOLOGICAL[name])
    df.write.mode("overwrite").format(kind).options(header=True).save(f"{folder}/{name}")


def read_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stage table written before; a clear error where the earlier step hasn't run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"Run the earlier pipeline steps first; missing {folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def code_hash() -> str:
    """A hash of this package's modules outside the corpus operators: results of other code aren't mixed with ours."""
    found = hashlib.sha256()
    root = Path(__file__).resolve().parent.parent
    for path in sorted(p for part in ("functions", "operators", "plans", "sources") for p in (root / part).glob("*.py")):
        found.update(path.read_bytes())
    return found.hexdigest()[:16]


def resume(spark: SparkSession, folder: str, name: str, controls: str, ids: list[int], compute: Callable[[list[int]], DataFrame], at_once: int = 1) -> DataFrame:
    """Compute the replicates that aren't committed yet, `at_once` in a job, and return the rows of all `ids`.

    `compute` gives rows with `replicate_id` for a list of replicates. A commit is a folder of its rows and of the
    replicates it claims, written under another name and renamed when it is whole: a run that was killed leaves nothing
    half done, and a replicate without rows is done too. Where two drivers committed a replicate, the first name counts.
    `controls` (inputs and settings) and the code are stored with every replicate; other ones are an error, not a mix.
    """
    base, controls = f"{folder}/{name}", f"{controls}|{code_hash()}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(base)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits() -> list[str]:
        return sorted(f.getPath().getName() for f in store.listStatus(root) if f.getPath().getName().startswith("commit-")) if store.exists(root) else []

    def claims() -> DataFrame:
        parts = [spark.read.parquet(f"{base}/{c}/done").withColumn("_commit", F.lit(c)) for c in commits()]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "replicate_id int, controls string, _commit string")

    def check(found: DataFrame) -> None:
        if found.where(F.col("controls") != controls).limit(1).count():
            raise ValueError("Inputs, settings or code changed; use a fresh output folder")

    done = claims()
    check(done)
    wanted = spark.createDataFrame([(i,) for i in ids], "replicate_id int")
    left = [r["replicate_id"] for r in wanted.join(done, "replicate_id", "left_anti").orderBy("replicate_id").collect()]
    for at in range(0, len(left), at_once):
        some, mark = left[at : at + at_once], uuid.uuid4().hex
        compute(some).write.parquet(f"{base}/_tmp-{mark}/rows")
        spark.createDataFrame([(i, controls) for i in some], "replicate_id int, controls string").coalesce(1).write.parquet(f"{base}/_tmp-{mark}/done")
        if not store.rename(hadoop.Path(f"{base}/_tmp-{mark}"), hadoop.Path(f"{base}/commit-{some[0]:06d}-{mark}")):
            raise OSError(f"Can't commit replicates {some} in {base}")
    found = claims()
    check(found)
    first = found.join(wanted, "replicate_id").groupBy("replicate_id").agg(F.min("_commit").alias("_commit"))
    rows = reduce(DataFrame.unionByName, (spark.read.parquet(f"{base}/{c}/rows").withColumn("_commit", F.lit(c)) for c in commits()))
    return rows.join(first, ["replicate_id", "_commit"]).drop("_commit")
