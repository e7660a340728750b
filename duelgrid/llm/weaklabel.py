"""Quality classifier: heuristic labellers weighed by expectation-maximisation teach a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.rows import map_rows
from duelgrid.llm.storage import materialize

#: Buckets of the hashed features.
FEATURE_BITS = 14
#: Distinct rows the scorer is fitted on, about (a hash sample of all rows); the labellers' accuracies come from all rows.
FIT_ROWS = 20_000
LABELLERS = ("prose", "plain_words", "length", "repetition", "symbols", "letters", "variety", "capitals", "punctuation", "word_length")
GOOD, BAD, ABSTAIN = "1", "0", "-"
_RUN = re.compile(r"(.)\1+")


def _good(holds: bool) -> str:
    return GOOD if holds else ABSTAIN


def _bad(holds: bool) -> str:
    return BAD if holds else ABSTAIN


def _shape(word: str) -> str:
    return _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def read_text(text: str | None) -> tuple[str, list[int], list[float]]:
    """(votes, feature buckets, feature values) of a whole text; no words: all abstain, no features."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return ABSTAIN * len(LABELLERS), [], []
    held = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = sum(c for c in windows.values() if c > 1) / max(1, n - 4)
    after_same = sum(a == b for a, b in zip(words, words[1:])) / n
    size = len(text)
    shapes: Counter = Counter()
    letters = upper = marks = symbols = chars = 0
    for word, times in held.items():
        shapes[_shape(word)] += times
        alpha = len(word) if word.isalpha() else sum(map(str.isalpha, word))
        letters += times * alpha
        chars += times * len(word)
        if not word.islower():
            upper += times * sum(map(str.isupper, word))
        if alpha < len(word):
            marks += times * sum(word.count(c) for c in ".,;:!?")
            symbols += times * sum(word.count(c) for c in "#*$%&|<>")
    variety = len(held) / n**0.85
    capitals = upper / max(letters, 1) if n >= 5 else 0.0
    plain = sum(times for shape, times in shapes.items() if shape.strip(".,;:!?") in {"a", "Aa", "A"}) / n
    # Objections are rare and each speaks of another kind of junk, so most labellers only object or abstain.
    votes = "".join(
        (
            _good(repeated <= 0.05 and symbols <= 0.01 * n and letters >= 0.75 * chars and capitals <= 0.1),
            _good(plain >= 0.9),
            _good(n >= 20),
            _bad(repeated > 0.3),
            _bad(symbols > 0.1 * n),
            _bad(letters < 0.65 * chars),
            _bad(n >= 20 and variety < 0.6),
            _bad(capitals > 0.3),
            _bad(n >= 5 and marks > 0.8 * n),
            _bad(not 2 <= chars / n <= 14),
        )
    )
    values = {f"s:{shape}": (times / n) ** 0.5 for shape, times in shapes.items()}
    for name, share in (("repeated", repeated), ("same", after_same), ("variety", min(variety, 2) / 2), ("letters", letters / chars), ("upper", upper / max(letters, 1)), ("symbols", min(symbols / n, 1)), ("spaces", 1 - chars / size)):
        values[f"{name}:{min(int(share * 20), 20)}"] = 1.0
    values[f"words:{n.bit_length()}"] = 1.0
    sums: dict[int, float] = {}
    for name, value in values.items():
        bucket = zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1)
        sums[bucket] = sums.get(bucket, 0.0) + value
    return votes, list(sums), list(sums.values())


def estimate_accuracies(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], dict[str, float]]:
    """(posterior of GOOD by vote pattern, accuracy by labeller), by expectation-maximisation over pattern counts.

    Each labeller has a distribution of votes (good, bad, abstain) for either class; votes are taken as independent
    given the class. It starts from bad where any labeller objects. There are at most 3 ** labellers patterns, at any size.
    """
    if not patterns:
        return {}, {}
    names, times = list(patterns), np.array(list(patterns.values()), np.float64)
    code = np.array([[(GOOD, BAD, ABSTAIN).index(v) for v in p] for p in names])
    good = (code == 0).sum(axis=1)
    bad = (code == 1).sum(axis=1)
    posterior = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    table = np.zeros((2, code.shape[1], 3))
    for _ in range(rounds):
        for cls, weight in enumerate((times * posterior, times * (1 - posterior))):
            for v in range(3):
                table[cls, :, v] = ((code == v) * weight[:, None]).sum(axis=0) + 1
            table[cls] /= table[cls].sum(axis=1, keepdims=True)
        prior = (times * posterior).sum() / times.sum()
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        at = np.arange(code.shape[1])
        score = np.log(prior / (1 - prior)) + (np.log(table[0][at, code]) - np.log(table[1][at, code])).sum(axis=1)
        fresh = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        done = np.abs(fresh - posterior).max() < 1e-9
        posterior = fresh
        if done:
            break
    right = (times[:, None] * ((code == 0) * posterior[:, None] + (code == 1) * (1 - posterior)[:, None])).sum(axis=0)
    said = (times[:, None] * (code < 2)).sum(axis=0)
    accuracy = {name: float(r / s) if s else float("nan") for name, r, s in zip(LABELLERS, right, said)}
    return dict(zip(names, posterior.tolist())), accuracy


def fit_scorer(rows: list[tuple[list[int], list[float], float, int]], rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer (the last one is the constant) on posterior labels, by accelerated gradient steps.

    Rows are (buckets, values, label, how many rows are like this one).
    """
    size = 1 << FEATURE_BITS
    weights = np.zeros(size + 1)
    if not rows:
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    bucket = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    value = np.concatenate([np.asarray(r[1], np.float64) for r in rows])
    target, times = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.float64)
    norms = np.bincount(owner, value**2, len(rows))
    step, ahead, last = 4 / (norms.max() + 1), weights.copy(), weights.copy()
    for turn in range(rounds):
        margin = np.bincount(owner, value * ahead[bucket], len(rows)) + ahead[-1]
        miss = (1 / (1 + np.exp(-margin)) - target) * times / times.sum()
        slope = np.append(np.bincount(bucket, value * miss[owner], size), miss.sum()) + ridge * np.append(ahead[:-1], 0)
        weights = ahead - step * slope
        ahead = weights + turn / (turn + 3) * (weights - last)
        last = weights
    return weights


def score_quality(docs: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, votes, posterior, score, kept) of every whole text; kept where score >= threshold.

    Votes and features are read once from each text and written to the shared folder. Votes of all rows are counted
    by pattern; expectation-maximisation runs on those counts. The scorer is fitted on about `fit_rows` distinct rows
    at most, chosen by a hash of their votes and features, weighed by how often they occur and labelled by their
    posterior; it then scores all rows. Null and text without words: score 0, not kept. Repeated rows, and rows of null
    ids, are each returned; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    read = materialize(map_rows(rows, lambda: lambda row: [(row[0], *read_text(row[1]))], f"_id {kind}, votes string, buckets array<int>, vals array<float>"), "quality")
    patterns = {r["votes"]: r["n"] for r in read.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, _ = estimate_accuracies(patterns)
    total = sum(patterns.values())
    bound = int(min(1.0, fit_rows / max(total, 1)) * 1_000_000)
    chosen = read.where(F.pmod(F.xxhash64("votes", "buckets", "vals"), F.lit(1_000_000)) < bound)
    # copies are one row with a count, so a text that fills a third of the table is read once
    sample = chosen.groupBy("votes", "buckets", "vals").agg(F.count(F.lit(1)).alias("n")).toPandas()
    sample = sample.assign(_order=[(p, list(b)) for p, b in zip(sample["votes"], sample["buckets"])]).sort_values("_order")
    weights = fit_scorer([(b, v, posterior[p], n) for b, v, p, n in zip(sample["buckets"], sample["vals"], sample["votes"], sample["n"])])
    held = docs.sparkSession.sparkContext.broadcast((weights, posterior))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, by_votes = held.value
        for part in parts:
            buckets, values = part.column(2), part.column(3)
            counts = np.diff(buckets.offsets.to_numpy())
            owner = np.repeat(np.arange(part.num_rows), counts)
            margin = np.bincount(owner, values.flatten().to_numpy().astype(np.float64) * w[buckets.flatten().to_numpy()], part.num_rows) + w[-1]
            score = np.where(counts > 0, 1 / (1 + np.exp(-margin)), 0.0)
            given = [by_votes[v] for v in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(given, pa.float64()), pa.array(score), pa.array(score >= threshold)], names=["_id", "votes", "posterior", "score", "kept"])

    return read.mapInArrow(work, f"_id {kind}, votes string, posterior double, score double, kept boolean").withColumnRenamed("_id", id_col)
