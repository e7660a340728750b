"""Language-model scoring: context-tree weighting over bytes, with an add-one unigram base."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm import ctw
from duelgrid.llm.storage import materialize

#: Keys (a context and the byte after it) that are broadcast with their probability at most; the others are joined.
MOST_KEYS = 1 << 20
#: A token is broadcast with its count if it is at least one of so many training tokens; the others are joined.
MOST_TOKENS = 1 << 19
#: Stands for a text's end among the tokens (no word holds a line feed).
END_TOKEN = "\n"
#: Texts whose words are counted together, and texts scored together, inside a task; bytes of such texts (or a single
#: text); rows in a batch that goes back.
SLICE, ROWS, BYTES, OUT_ROWS = 1024, 512, 1 << 21, 1 << 16
LN2, LN10 = math.log(2.0), math.log(10.0)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _slices(texts: pa.Array, rows: int) -> Iterator[tuple[int, list[str | None]]]:
    """(place, texts) of neighbours: at most `rows` of them, and BYTES together unless it is one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        end = min(at + rows, max(at + 1, fits))
        yield at, texts.slice(at, end - at).to_pylist()
        at = end


def count_tokens(rows: DataFrame) -> DataFrame:
    """(token, n): counts of tokens over all texts of `_text`."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, texts in _slices(part.column(0), SLICE):
                held: Counter = Counter()
                for text in texts:
                    held.update(_words(text))
                names = [END_TOKEN, *(w.decode("utf-8", "replace") for w in held)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(texts), *held.values()], pa.int64())], names=["token", "n"])

    return rows.mapInArrow(work, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def count_contexts(rows: DataFrame, depth: int) -> DataFrame:
    """(code, byte, n): how often a byte follows a context of `depth` bytes, over all texts of `_text`."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (ctw.text_bytes(t) for part in parts for _, some in _slices(part.column(0), SLICE) for t in some)
        for keys, n in ctw.counted(texts, depth):
            for at in range(0, len(keys), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + OUT_ROWS]), pa.array(n[at : at + OUT_ROWS])], names=["key", "n"])

    summed = rows.mapInArrow(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return summed.select(F.shiftright("key", 8).alias("code"), F.col("key").bitwiseAND(255).cast("int").alias("byte"), "n")


def log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8; error below 1e-12 for x >= 0.5."""
    shift = x
    for k in range(1, 8):
        shift = shift * (x + k)
    z = x + 8
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(shift)


def log_kt(a: str, b: str) -> Column:
    """Log probability that Krichevsky and Trofimov's estimator gives to a zeros and b ones, in any order."""
    zeros, ones = F.col(a).cast("double"), F.col(b).cast("double")
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def byte_path(byte: str) -> Column:
    """The 8 (node, bit) pairs that lead to a byte: node 1 is the top, node i is above 2i (bit 0) and 2i + 1 (bit 1)."""
    steps = [F.struct(F.expr(f"{1 << k} | shiftright({byte}, {8 - k})").alias("node"), F.expr(f"shiftright({byte}, {7 - k}) & 1").alias("bit")) for k in range(8)]
    return F.array(*steps)


def suffix(depth: int, code: str = "code") -> Column:
    """The `depth` last bytes of a context."""
    return F.col(code).bitwiseAND((1 << 8 * depth) - 1)


def fit_tree(counts: DataFrame, depth: int) -> list[DataFrame]:
    """For each context length 0..depth: (code, node, chance), the probability of a 1 at a node of the next byte.

    `counts` is `count_contexts`. Each node of the byte's binary decomposition has a context tree of its own: a node's
    weighted probability is half its KT estimate plus half the product over its longer contexts. From the longest
    contexts up, sums of counts and of weighted log probabilities are grouped by the suffix; from the root down, each
    context meets its suffix and mixes the KT estimates of all lengths by the posterior weights of stopping at each.
    `chance` is the mixture as it stands where no longer context is known. Every context of the training texts is kept,
    and no step passes through the driver.
    """
    seen = counts.select("code", "n", F.explode(byte_path("byte")).alias("_s")).select("code", "n", F.col("_s.node").alias("node"), F.col("_s.bit").alias("bit"))
    level = seen.groupBy("code", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("b"))
    level = materialize(level.withColumns({"weighted": log_kt("a", "b"), "stop": F.lit(1.0)}), "level")
    levels = [level]
    for d in range(depth - 1, -1, -1):
        level = level.groupBy(suffix(d).alias("code"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("_below"))
        level = level.withColumn("_direct", log_kt("a", "b"))
        both = F.greatest("_direct", "_below") + F.log1p(F.exp(-F.abs(F.col("_direct") - F.col("_below")))) - LN2
        level = level.withColumn("weighted", both).withColumn("stop", F.exp(F.col("_direct") - LN2 - F.col("weighted")))
        level = materialize(level.select("code", "node", "a", "b", "weighted", "stop"), "level")
        levels.append(level)
    levels.reverse()
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    out: list[DataFrame] = []
    for d, level in enumerate(levels):
        own = level.select("code", "node", "stop", one.alias("_one"))
        if d:
            above = out[-1].select(F.col("code").alias("_up"), F.col("node").alias("_at"), F.col("held").alias("_held"), F.col("free").alias("_free"))
            own = own.join(above, (suffix(d - 1) == F.col("_up")) & (F.col("node") == F.col("_at")))
        else:
            own = own.withColumns({"_held": F.lit(0.0), "_free": F.lit(1.0)})
        mixed = own.select("code", "node", (F.col("_held") + F.col("_free") * F.col("_one")).alias("chance"), (F.col("_held") + F.col("_free") * F.col("stop") * F.col("_one")).alias("held"), (F.col("_free") * (1 - F.col("stop"))).alias("free"))
        out.append(materialize(mixed, "mixed"))
    return [level.select("code", "node", "chance") for level in out]


def _log10_of(chance: Column, bit: Column) -> Column:
    sure = F.least(F.greatest(chance, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log10(F.when(bit == 1, sure).otherwise(1 - sure))


def known_keys(counts: DataFrame, deepest: DataFrame) -> DataFrame:
    """(key, n, log10p) of every context and byte of the training texts."""
    # a context has at most 255 nodes, so its map is short
    by_code = deepest.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("node", "chance"))).alias("_at"))
    met = counts.join(by_code, "code")
    logs = F.aggregate(byte_path("byte"), F.lit(0.0), lambda total, s: total + _log10_of(F.element_at("_at", s["node"]), s["bit"]))
    return met.select(F.shiftleft("code", 8).bitwiseOR(F.col("byte").cast("long")).alias("key"), "n", logs.alias("log10p"))


def unknown_keys(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, log10p) of other keys: each node of the byte is decided in the longest context that knows it."""
    path = keys.select("key", F.shiftright("key", 8).alias("_code"), F.explode(byte_path("cast(key & 255 as int)")).alias("_s")).select("key", "_code", F.col("_s.node").alias("node"), F.col("_s.bit").alias("bit"))
    asked = path.select("*", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), suffix(d, "_code").alias("code")) for d in range(len(levels))))).alias("_l"))
    asked = asked.select("key", "node", "bit", F.col("_l.d").alias("d"), F.col("_l.code").alias("code"))
    table = levels[0].withColumn("d", F.lit(0))
    for d, level in enumerate(levels[1:], 1):
        table = table.unionByName(level.withColumn("d", F.lit(d)))
    met = asked.join(table, ["d", "code", "node"], "left")
    best = met.groupBy("key", "node", "bit").agg(F.max(F.when(F.col("chance").isNotNull(), F.struct("d", "chance"))).alias("_best"))
    return best.groupBy("key").agg(F.sum(_log10_of(F.coalesce("_best.chance", F.lit(0.5)), F.col("bit"))).alias("log10p"))


def frequent(keys: DataFrame, most: int) -> ctw.KeyTable:
    """The most frequent keys, at most `most` of them, with their log probabilities."""
    octave = F.floor(F.log2("n") * 8).cast("int")
    left, least = most, None
    for row in sorted(keys.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        left -= row["n"]
        if left < 0:
            break
        least = row["o"]
    chosen = keys.where(octave >= least if least is not None else F.lit(False)).select("key", "log10p").toArrow()
    return ctw.KeyTable(chosen["key"].to_numpy(), chosen["log10p"].to_numpy())


def _counted(owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, times) of the distinct pairs, in order."""
    order = np.lexsort((keys, owners))
    owners, keys = owners[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], (owners[1:] != owners[:-1]) | (keys[1:] != keys[:-1])))) if len(keys) else np.zeros(0, np.int64)
    return owners[first], keys[first], np.diff(np.append(first, len(keys)))


def _pair_lists(owners: np.ndarray, names: pa.Array, times: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
    """A list of (name, times) for each of `rows` owners; owners ascend."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=rows)))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([names, pa.array(times, pa.int32())], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), pairs, type=kind)


def score_texts(docs: DataFrame, train: Column, depth: int = ctw.DEPTH, most_keys: int = MOST_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text.

    The model learns from all rows for which `train` holds (null: it doesn't), and holds every context of them. `score` is
    its log10 probability of the text's UTF-8 bytes, A-Z lower-cased, and their end; bits_per_byte is the code length.
    `base_score` is the add-one unigram log10 probability of the words and their end. The most frequent keys (at most
    `most_keys`) and tokens (MOST_TOKENS) are looked up where the text is read; a document's other keys and tokens are
    joined with the model's tables, so what an executor holds doesn't grow with the corpus.

    Null texts are empty: only the end is scored. Repeated rows are each returned; with no training rows all bytes have
    probability 1/256. Other columns are not read; an empty table gives no rows.
    """
    if not 1 <= depth <= ctw.MOST_DEPTH:
        raise ValueError(f"depth must be 1 to {ctw.MOST_DEPTH}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    learn = rows.where("_train").select("_text")
    tokens = materialize(count_tokens(learn), "tokens")
    size = tokens.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    kinds, total = size["kinds"], size["all"]
    often = {r["token"]: r["n"] for r in tokens.where(F.col("n") >= max(2.0, total / MOST_TOKENS)).collect()}
    counts = materialize(count_contexts(learn, depth), "contexts")
    levels = fit_tree(counts, depth)
    known = materialize(known_keys(counts, levels[-1]), "keys")
    logs = {w.encode("utf-8"): float(np.log10(n + 1)) for w, n in often.items()}
    table = frequent(known, most_keys)
    # as arrays, of which a worker holds one copy
    held = spark.sparkContext.broadcast((table.keys, table.values, logs))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _n_bytes bigint, _n bigint, _known bigint, _part double, _score double, _rare array<struct<token:string,times:int>>, _keys array<struct<key:bigint,times:int>>"

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *arrays, common = held.value
        table = ctw.KeyTable.of(*arrays)
        of_tokens, of_keys = (pa.list_(pa.struct([(name, t), ("times", pa.int32())])) for name, t in (("token", pa.string()), ("key", pa.int64())))
        end = common.get(END_TOKEN.encode())
        for part in parts:
            for at, texts in _slices(part.column(1), ROWS):
                n, sure, base, owners, names, times = [], [], [], [], [], []
                for number, text in enumerate(texts):
                    words = _words(text)
                    ours, seen, log = Counter(words), int(end is not None), end or 0.0
                    for word, count in ours.items():
                        found = common.get(word)
                        if found is None:
                            owners.append(number)
                            names.append(word)
                            times.append(count)
                        else:
                            seen += count
                            log += count * found
                    if end is None:
                        owners.append(number)
                        names.append(END_TOKEN.encode())
                        times.append(1)
                    n.append(len(words) + 1)
                    sure.append(seen)
                    base.append(log)
                raw = [ctw.text_bytes(t) for t in texts]
                score, missed = np.zeros(len(texts)), []
                for batch in ctw.pieces(raw, depth):
                    owner, keys = ctw.contexts(batch, depth)
                    there, log10p = table.find(keys)
                    score += np.bincount(owner, log10p, len(texts))
                    missed.append((owner[~there], keys[~there]))
                whose, which, repeats = _counted(*(np.concatenate([m[i] for m in missed]) for i in (0, 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(at, len(texts)), pa.array([len(r) - 1 for r in raw], pa.int64()), pa.array(n, pa.int64()), pa.array(sure, pa.int64()), pa.array(base, pa.float64()), pa.array(score),
                        _pair_lists(np.array(owners, np.int64), pa.array([w.decode("utf-8", "replace") for w in names], pa.string()), np.array(times), len(texts), of_tokens),
                        _pair_lists(whose, pa.array(which, pa.int64()), repeats, len(texts), of_keys),
                    ],
                    names=["_id", "_n_bytes", "_n", "_known", "_part", "_score", "_rare", "_keys"],
                )

    read = materialize(rows.select("_id", "_text").mapInArrow(work, schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    asked = read.select("_row", F.explode("_rare").alias("_r")).select("_row", F.col("_r.token").alias("token"), F.col("_r.times").alias("times"))
    joined = asked.join(tokens, "token").groupBy("_row").agg(F.sum("times").alias("_more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_rest"))
    missed = read.select("_row", F.explode("_keys").alias("_r")).select("_row", F.col("_r.key").alias("key"), F.col("_r.times").alias("times"))
    wanted = materialize(missed.select("key").distinct(), "wanted")
    new = unknown_keys(wanted.join(known, "key", "left_anti"), levels)
    answers = materialize(known.select("key", "log10p").join(wanted, "key", "left_semi").unionByName(new), "answers")
    deeper = missed.join(answers, "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("log10p")).alias("_deeper"))
    met = read.drop("_rare", "_keys").join(joined, "_row", "left").join(deeper, "_row", "left")
    base = F.col("_part") + F.coalesce("_rest", F.lit(0.0)) - F.col("_n") * F.lit(float(np.log10(total + kinds + 1)))
    score = F.col("_score") + F.coalesce("_deeper", F.lit(0.0))
    return met.select(
        F.col("_id").alias(id_col),
        F.col("_n_bytes").alias("n_bytes"),
        F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        (-score / F.lit(float(np.log10(2.0))) / (F.col("_n_bytes") + 1)).alias("bits_per_byte"),
    )
