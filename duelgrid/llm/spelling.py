"""Spelling variants: words one edit apart, found by probing generated edits against broadcast Bloom filters."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.bloom import KEYS_PER_BLOCK, MOST_BLOCKS, build, mixed
from duelgrid.llm.rows import SLICE, share, shared
from duelgrid.llm.storage import Scratch, materialize

#: Runs of letters in a text whose A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 1 << 18
#: Words of so many letters and longer share a filter.
LONG = 64
#: Base of the polynomial that hashes a word, and its inverse modulo 2^64, with which a deleted letter is taken out.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Edits that are hashed at once.
EDITS = 1 << 20


def count_words(docs: DataFrame, least_letters: int = 6, slip_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters (A-Z lower-cased) of whole texts that have at least `least_letters` code points.

    With `slip_every`, runs lose a letter at places fixed by a hash: let h be the crc32 of `<id>:<run>`; where `slip_every`
    divides h, code point h % length is deleted. A task counts what it reads, at most HELD_WORDS words at a time, and the
    shuffle carries words with counts. Null texts have no words; a null id counts as an empty one.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in parts:
            for at in range(0, part.num_rows, SLICE):
                piece = part.slice(at, SLICE)
                for name, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    runs = Counter(m.group() for m in RUN.finditer(_lower(text))) if len(text) > 1 << 20 else Counter(RUN.findall(_lower(text)))
                    start = zlib.crc32(f"{name}:".encode())
                    for run, n in runs.items():
                        if len(run) >= least_letters:
                            if slip_every and (h := zlib.crc32(run.encode(), start)) % slip_every == 0:
                                at_letter = h % len(run)
                                run = run[:at_letter] + run[at_letter + 1 :]
                                if len(run) < least_letters:
                                    continue
                            counts[run] += n
                    if len(counts) >= HELD_WORDS:
                        yield _counted(counts)
                        counts = Counter()
        if counts:
            yield _counted(counts)

    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = docs.where(F.col(text_col).isNotNull()).select(named.alias("name"), F.col(text_col).alias("text")).mapInArrow(work, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, [word, letter] code points) of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, EDITS // max(int(length), 1))
        for first in range(0, len(at), step):
            some = at[first : first + step]
            codes = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le", "surrogatepass"), "<u4")
            yield some, codes.reshape(len(some), length)


def _values(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _powers(length: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(length - 1, 0), BASE, np.uint64)])


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit polynomial of the letters of each word, as signed longs."""
    out = np.zeros(len(words), np.uint64)
    for at, codes in _by_length(words):
        out[at] = (_values(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def edits(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, hash, length) of every word that a deletion, or a replacement by a later letter, makes of words of one length.

    Of two words one edit apart, one is longer and gives the other by a deletion, or both have one length and the one
    with the earlier letter gives the other: each pair is generated once. A hash is found from those of the word's
    parts, without the edited word. Of equal neighbouring letters only the last is deleted.
    """
    rows, length = codes.shape
    if not length:
        return
    powers, values = _powers(length), _values(codes)
    terms = values * powers
    sums = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = sums[:, -1]
    last = np.ones(codes.shape, bool)
    last[:, :-1] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(last)
    yield row, sums[row, at] - terms[row, at] + (whole[row] - sums[row, at]) * np.uint64(INVERSE), length - 1
    every = _values(letters)
    step = max(1, EDITS // max(1, rows * len(letters)))
    for first in range(0, length, step):
        row, at, letter = np.nonzero(letters[None, None, :] > codes[:, first : first + step, None])
        at += first
        yield row, whole[row] + (every[letter] - values[row, at]) * powers[at], length


def _near_pairs(words: DataFrame, held: Scratch) -> DataFrame:
    """(word, n, other, m) of words (word, n, h, shard) one edit apart, each pair once."""
    letters = np.sort(np.array([r["c"] for r in words.select(F.explode(F.expr("transform(split(word, ''), c -> ascii(c))")).alias("c")).distinct().collect() if r["c"]], np.uint32))
    sizes = {r["shard"]: r["count"] for r in words.groupBy("shard").count().collect()}
    groups: list[list[int]] = [[]]
    for shard in sorted(sizes):
        if groups[-1] and sum(sizes[s] for s in groups[-1]) + sizes[shard] > MOST_BLOCKS * KEYS_PER_BLOCK:
            groups.append([])
        groups[-1].append(shard)
    spark, found = words.sparkSession, None
    for group in groups:
        filters = share(spark, build(words.where(F.col("shard").isin(group)).select("h", "shard"), LONG + 1))
        wanted = frozenset(group)

        def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bloom = shared(filters)
            for part in parts:
                for at in range(0, part.num_rows, 4096):
                    piece = part.slice(at, 4096)
                    for rows, codes in _by_length(piece.column(0).to_pylist()):
                        step = max(1, EDITS // (codes.shape[1] * max(len(letters), 1) or 1))
                        for first in range(0, len(codes), step):
                            for row, hashes, length in edits(codes[first : first + step], letters):
                                if min(length, LONG) in wanted:
                                    hit = bloom.possible(hashes, min(length, LONG))
                                    taken = piece.take(pa.array(rows[first + row[hit]]))
                                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(hashes[hit].view(np.int64))], names=["word", "n", "h"])

        hits = words.where(F.col("shard").isin(*{min(s, LONG) for g in group for s in (g, g + 1)})).select("word", "n").mapInArrow(probe, "word string, n bigint, h bigint")
        found = hits if found is None else found.unionByName(hits)
    found = held.write(found, "possible")
    others = words.select("h", F.col("word").alias("other"), F.col("n").alias("m"))
    return found.join(others, "h").where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "m").distinct()


def spelling_variants(counts: DataFrame, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of `counts` (word, n) that occur at least `least_count` times.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near
    word of largest n (ties: the first in code-point order), if that n is at least `ratio` times its own; `root` follows
    forms to the last. n_near is 0 and form and form_n are null for words without.

    Search: a task generates each word's deletions and replacements as hashes and probes them in Bloom filters that hold
    the vocabulary by length; the filters of a broadcast have 64 MB at most, and more words than these are meant for are
    taken in further broadcasts, some lengths at a time. Only what passes is shuffled, to meet the vocabulary by hash,
    and pairs are decided on the words. A form has `ratio` times the occurrences, so chains of forms are as short as the
    logarithm of the largest count, and are halved in every round.

    Null words and counts are left out; an empty table gives no rows; a word that repeats is counted in sum.
    """
    held = Scratch()
    summed = counts.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)

    def add_hash(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(word_hashes(part.column(0).to_pylist()))], names=["word", "n", "h"])

    hashed = summed.select("word", "n").mapInArrow(add_hash, "word string, n bigint, h bigint")
    words = held.write(hashed.withColumn("shard", F.least(F.char_length("word"), F.lit(LONG))), "words")
    pairs = held.write(_near_pairs(words, held), "near")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("_best"))
    judged = words.select("word", "n").join(near, "word", "left")
    form_n = -F.col("_best.m")
    is_form = form_n >= ratio * F.col("n")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("_best.other")).alias("form"), F.when(is_form, form_n).alias("form_n"))
    judged = held.write(judged, "judged")
    roots = held.write(judged.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        moved = held.write(further.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    named = judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = materialize(named, "variants")
    held.clear()
    return out
