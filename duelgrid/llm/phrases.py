"""Phrase collocations: Rabin-Karp fingerprints of all n-grams are counted, texts are asked for the frequent ones only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.bloom import build, mixed
from duelgrid.llm.rows import share, shared
from duelgrid.llm.storage import Scratch, keep_possible, materialize

#: Bytes that end a piece of text, and those that part words inside a piece.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text that are hashed at once, words whose n-grams are, and n-grams that a task merges before it hands them on.
BYTES, WORDS, GRAMS = 1 << 19, 1 << 18, 1 << 19
#: Bases of the polynomials of bytes and of words, and their inverses modulo 2^64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
INVERSES = {b: pow(b, -1, 1 << 64) for b in (BYTE_BASE, WORD_BASE)}
#: Name of the language of rows without one.
UNKNOWN = "und"
FINGERPRINTS = "fp bigint, n bigint, text_key bigint, low bigint, high bigint, lang string"


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(count - 1, 0), base, np.uint64)])


class Hasher:
    """Two polynomial fingerprints of phrases in a language; the first one is cut to `bits`, which only tests set."""

    def __init__(self, bits: int = 64):
        kinds = np.zeros(256, np.uint8)
        kinds[list(BLANKS)], kinds[list(ENDS)] = 1, 2
        lower = np.arange(256)
        lower[65:91] += 32
        self.kinds = kinds
        self.values = [mixed(lower.astype(np.uint64) + np.uint64(seed)) for seed in (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7)]
        self.powers = {b: _powers(b, 1) for b in INVERSES}
        self.inverses = {b: _powers(i, 1) for b, i in INVERSES.items()}
        self.kept = np.uint64((1 << bits) - 1)

    def _to(self, base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers[base]) < count:
            count = 1 << (count - 1).bit_length()
            self.powers[base], self.inverses[base] = _powers(base, count), _powers(INVERSES[base], count)
        return self.powers[base], self.inverses[base]

    def words(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, piece, hash, hash) of the words of a text in bytes, which is read in spans that end between words."""
        parts, begin, pieces = [], 0, 0
        while begin < len(data):
            end = begin + BYTES
            while end < len(data):
                gap = np.flatnonzero(self.kinds[data[end : end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end += 4096
            span = data[begin:end]
            kind = self.kinds[span]
            edge = np.diff(np.r_[np.int8(0), (kind == 0).view(np.int8), np.int8(0)])
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            piece = np.cumsum(kind == 2)
            powers, inverses = self._to(BYTE_BASE, len(span))
            marks = []
            for values in self.values:
                sums = np.r_[np.uint64(0), np.cumsum(values[span] * powers[: len(span)], dtype=np.uint64)]
                marks.append(mixed((sums[last] - sums[first]) * inverses[first]))
            parts.append((first + begin, last + begin, piece[first] + pieces, *marks))
            begin, pieces = end, pieces + int(piece[-1])
        if not parts:
            return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64), np.empty(0, np.uint64))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def grams(self, marks: list[np.ndarray], n: int) -> list[np.ndarray]:
        """Both fingerprints of the n words from each word on, language aside."""
        count = len(marks[0]) - n + 1
        powers, inverses = self._to(WORD_BASE, len(marks[0]))
        out = []
        for hashes in marks:
            sums = np.r_[np.uint64(0), np.cumsum(hashes * powers[: len(hashes)], dtype=np.uint64)]
            out.append((sums[n:] - sums[:count]) * inverses[:count])
        return out

    def named(self, grams: list[np.ndarray], seeds: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints as signed longs, with the language's seeds and the number of words."""
        first, second = (mixed(g + s + np.uint64(n * 0xA0761D6478BD642F & (1 << 64) - 1)) for g, s in zip(grams, seeds))
        return (first & self.kept).view(np.int64), second.view(np.int64)


def _seeds(lang: str) -> tuple[int, int]:
    digest = hashlib.md5(lang.encode()).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list, pa.RecordBatch]]:
    """(langs, keys, texts, rows) of some rows: of about BYTES of text, or of one longer text."""
    for part in parts:
        at = 0
        while at < part.num_rows:
            texts, size, first = [], 0, at
            while at < part.num_rows and (not texts or size + len(texts[-1]) < BYTES):
                texts.append(part.column(2)[at].as_buffer().to_pybytes())
                size += len(texts[-1])
                at += 1
            piece = part.slice(first, at - first)
            yield piece.column(0).to_pylist(), piece.column(1).to_numpy(), texts, piece


def _scan(hasher: Hasher, block: tuple, widths: range, ahead: int = 0) -> Iterator[tuple]:
    """(n, first word, fingerprint, second, valid, row, words) of all n-grams of a block, by stretch of words and width.

    Stretches of all widths but the last one reach `ahead` n-grams into the next stretch.
    """
    langs, _, texts, _ = block
    start, end, piece, *marks = hasher.words(np.frombuffer(b"\n".join(texts), np.uint8))
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    pairs = np.array([_seeds(x) for x in langs], np.uint64).reshape(-1, 2)
    for first in range(0, len(start), WORDS):
        for n in widths:
            last = min(len(start), first + WORDS + n - 1 + (ahead if n < widths[-1] else 0))
            if last - first >= n:
                some = [m[first:last] for m in marks]
                count = last - first - n + 1
                rows = row[first : first + count]
                one, two = hasher.named(hasher.grams(some, n), [pairs[rows, 0], pairs[rows, 1]], n)
                valid = piece[first : first + count] == piece[first + n - 1 : last]
                yield n, first, one, two, valid, rows, (start, end)


def _merged(fp: np.ndarray, n: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """One row a fingerprint: occurrences, the smallest text key, smallest and largest second fingerprint."""
    order = np.argsort(fp)
    fp = fp[order]
    first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
    columns = [fp[first], np.add.reduceat(n[order], first), np.minimum.reduceat(key[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(first), pa.string())], names=["fp", "n", "text_key", "low", "high", "lang"])


def _count_grams(docs: DataFrame, n: int, parts_of: object, bits: int) -> DataFrame:
    """(fp, n, text_key, low, high, lang) of all n-grams whose two parts of n - 1 words may be frequent (all for n = 1).

    With n = 1, rows with `lang` count the words of a language.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bloom = Hasher(bits), parts_of and shared(parts_of)
        held: list[tuple] = []
        totals: dict[str, int] = {}
        for block in _blocks(parts):
            shorter = {}
            for width, first, one, two, valid, rows, _ in _scan(hasher, block, range(max(1, n - 1), n + 1), ahead=1):
                if width < n:
                    frequent = np.zeros(len(one), bool)
                    frequent[bloom.possible(one.view(np.uint64))] = True
                    shorter = {first: frequent}
                    continue
                if n == 1:
                    for row, count in zip(*np.unique(rows, return_counts=True)):
                        totals[block[0][row]] = totals.get(block[0][row], 0) + int(count)
                else:
                    near = shorter[first]
                    valid = valid & near[: len(valid)] & near[1 : len(valid) + 1]
                one, two, keys = one[valid], two[valid], block[1][rows[valid]]
                held.append((one, np.ones(len(one), np.int64), keys, two, two))
                if sum(len(h[0]) for h in held) >= GRAMS:
                    yield _merged(*map(np.concatenate, zip(*held)))
                    held = []
        if held and sum(len(h[0]) for h in held):
            yield _merged(*map(np.concatenate, zip(*held)))
        if totals:
            none = [0] * len(totals)
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(totals.values(), pa.int64()), *[pa.array(none, pa.int64())] * 3, pa.array(totals, pa.string())], names=["fp", "n", "text_key", "low", "high", "lang"])

    return docs.select("_lang", "_key", "_text").mapInArrow(work, FINGERPRINTS)


def _phrase(text: bytes, start: np.ndarray, end: np.ndarray, at: int, n: int) -> str:
    return b" ".join(text[start[i] : end[i]] for i in range(at, at + n)).lower().decode("utf-8", "surrogatepass")


def _recounted(docs: DataFrame, collided: DataFrame, most_words: int, bits: int) -> DataFrame:
    """(fp, second, n, lang, phrase) of all phrases of the fingerprints that several ones share, counted by their text."""
    filters = share(docs.sparkSession, build(collided.select(F.col("fp").alias("h"), F.lit(0).alias("shard"))))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bloom = Hasher(bits), shared(filters)
        for block in _blocks(parts):
            data, counts = b"\n".join(block[2]), {}
            for n, first, one, two, valid, rows, (start, end) in _scan(hasher, block, range(1, most_words + 1)):
                hit = bloom.possible(one.view(np.uint64))
                for at in hit[valid[hit]].tolist():
                    found = (int(one[at]), int(two[at]), block[0][rows[at]], _phrase(data, start, end, first + at, n))
                    counts[found] = counts.get(found, 0) + 1
            if counts:
                columns = list(zip(*(((*k, v) for k, v in counts.items()))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "second", "lang", "phrase", "n"])

    rows = docs.select("_lang", "_key", "_text").mapInArrow(work, "fp bigint, second bigint, lang string, phrase string, n bigint")
    return rows.groupBy("fp", "second", "lang", "phrase").agg(F.sum("n").alias("n")).join(collided.select("fp"), "fp").select("fp", "second", "n", "lang", "phrase")


def _materialised(docs: DataFrame, wanted: DataFrame, most_words: int, bits: int, held: Scratch) -> DataFrame:
    """(fp, second, n, lang, phrase) of fingerprints (fp, n, text_key, low): their words, read in the texts they point to."""
    pointers = held.write(wanted.groupBy("text_key").agg(F.collect_list(F.struct("fp", "low", "n")).alias("_wanted")), "pointers")
    texts = keep_possible(docs.select(F.col("_key").alias("text_key"), "_lang", "_text"), pointers.select("text_key"), "text_key")
    # texts of equal key but different words stay apart: the one that holds the fingerprints gives their words
    texts = texts.groupBy("text_key", F.xxhash64(F.lit(1), "_text", "_lang").alias("_more")).agg(F.first("_lang").alias("_lang"), F.first("_text").alias("_text"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for block in _blocks(parts):
            wanted = {(w["fp"], w["low"]): w["n"] for row in block[3].column(3).to_pylist() for w in row}
            asked, data, out = np.sort(np.array([k[0] for k in wanted], np.int64)), b"\n".join(block[2]), []
            for n, first, one, two, valid, rows, (start, end) in _scan(hasher, block, range(2, most_words + 1)):
                place = np.minimum(np.searchsorted(asked, one), len(asked) - 1)
                for i in np.flatnonzero(valid & (asked[place] == one)).tolist():
                    count = wanted.pop((int(one[i]), int(two[i])), None)
                    if count is not None:
                        out.append((int(one[i]), int(two[i]), count, block[0][rows[i]], _phrase(data, start, end, first + i, n)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["fp", "second", "n", "lang", "phrase"])

    met = texts.join(pointers, "text_key").select("_lang", "text_key", "_text", "_wanted")
    return met.mapInArrow(work, "fp bigint, second bigint, n bigint, lang string, phrase string").dropDuplicates(["fp", "second"])


def _parts(phrases: DataFrame, bits: int) -> DataFrame:
    """`phrases` with `cuts` (k, side, fp, second) of each cut's two parts and `inner` (fp, second) of the shorter phrases inside."""
    pair = "fp: bigint, second: bigint"

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for part in parts:
            fps, seconds, _, langs, texts = (c.to_pylist() for c in part.columns)
            # each phrase is a piece of its own
            _, _, row, *marks = hasher.words(np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8))
            sizes = np.bincount(row, minlength=len(texts))
            pairs, of = np.array([_seeds(x) for x in langs], np.uint64).reshape(-1, 2), {}
            for n in range(1, int(sizes.max(initial=0)) + 1):
                seeds = pairs[row[: len(row) - n + 1]]
                of[n] = [x.tolist() for x in hasher.named(hasher.grams(marks, n), [seeds[:, 0], seeds[:, 1]], n)]
            gram = lambda n, at: {"fp": of[n][0][at], "second": of[n][1][at]}
            cuts, inner, kept, first = [], [], [], 0
            for fp, second, size in zip(fps, seconds, sizes.tolist()):
                kept.append(gram(size, first) == {"fp": fp, "second": second})
                cuts.append([{"k": k, "side": side, **gram(*at)} for k in range(1, size) for side, at in ((0, (k, first)), (1, (size - k, first + k)))])
                inner.append([gram(n, first + i) for n in range(2, size) for i in range(size - n + 1)])
                first += size
            as_pair = pa.struct([("fp", pa.int64()), ("second", pa.int64())])
            as_cut = pa.struct([("k", pa.int32()), ("side", pa.int32()), *as_pair])
            whole = pa.RecordBatch.from_arrays([*part.columns, pa.array(cuts, pa.list_(as_cut)), pa.array(inner, pa.list_(as_pair))], names=[*part.schema.names, "cuts", "inner"])
            yield whole.filter(pa.array(kept, pa.bool_()))

    schema = f"fp bigint, second bigint, n bigint, lang string, phrase string, cuts array<struct<k: int, side: int, {pair}>>, inner array<struct<{pair}>>"
    return phrases.select("fp", "second", "n", "lang", "phrase").mapInArrow(work, schema)


def _ranked(scored: DataFrame, top: int | None, held: Scratch) -> DataFrame:
    """`scored` with the rank inside its language: sorted in ranges, whose rows by language give each range its offset."""
    order = ["lang", F.desc("score"), F.desc("a"), "phrase"]
    rows = held.write(scored.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted").withColumn("_range", F.shiftright("_id", 33))
    ranges = rows.groupBy("lang", "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("lang", "_range", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    ranked = rows.join(offsets, ["lang", "_range"]).withColumn("rank", F.col("_id") + F.col("_offset"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, most_words: int = 3, least: int = 10, top: int | None = 2000, covered_percent: int = 50, text_col: str = "text", lang_col: str = "lang", bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` phrases of 2 to `most_words` words (None: all).

    Texts, with A-Z lower-cased, are split into pieces at ENDS and pieces into words at BLANKS. a counts a phrase's
    contiguous occurrences inside pieces, n a language's words. A phrase of at least `least` occurrences is cut after its
    first k words; with l and r occurrences of the two parts, its score is floor(1000000 a a / (l r)), the lowest of its
    cuts (ties: smallest k). Phrases inside a longer one of at least `least` occurrences that makes up `covered_percent`
    of theirs are dropped. Order: score and a descending, then phrase by its bytes. Counts are exact up to 10^16.

    Search: by length, prefix polynomials give a fingerprint of every n-gram whose shorter parts may be frequent (a Bloom
    filter of 64 MB at most says so; a fuller one lets more pass). Tasks merge what they read, the shuffle adds up
    fingerprints, each with the smallest key of a text that holds it as its pointer and the range of a second
    fingerprint. Where that range isn't one value, phrases collide, and all phrases of that fingerprint are counted anew
    by their text. Only frequent phrases are read from the texts that pointers name, where both fingerprints must agree.
    Ranks come from ranges of the sorted phrases and their sizes, so that no language meets in one task.

    A null lang is UNKNOWN's, a null text is empty; rows without words, and an empty table, give no phrases. Repeated rows
    count as often as they occur. Other columns are not read.
    """
    held, spark = Scratch(), docs.sparkSession
    lang = F.coalesce(F.col(lang_col), F.lit(UNKNOWN))
    rows = docs.where(F.col(text_col).isNotNull()).select(lang.alias("_lang"), F.xxhash64(text_col, lang).alias("_key"), F.col(text_col).alias("_text"))
    levels, bloom, totals = [], None, None
    for n in range(1, most_words + 1):
        grams = _count_grams(rows, n, bloom, bits).groupBy("fp", *["lang"] * (n == 1)).agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.min, "text_key"), (F.min, "low"), (F.max, "high"))))
        if n == 1:
            counted = held.write(grams.where((F.col("n") >= least) | F.col("lang").isNotNull()), "words")
            totals, counted = counted.where("lang is not null").select("lang", F.col("n").alias("_words")), counted.where("lang is null")
        else:
            counted = held.write(grams.where(F.col("n") >= least), f"grams{n}")
        levels.append(counted.select("fp", "n", "text_key", "low", "high", F.lit(n).alias("width")))
        if n < most_words:
            bloom = share(spark, build(levels[-1].select(F.col("fp").alias("h"), F.lit(0).alias("shard"))))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    # cut to few bits, phrases of different lengths collide too
    every = every.groupBy("fp").agg(F.sum("n").alias("n"), F.min("text_key").alias("text_key"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("width").alias("width")) if bits < 64 else every
    single = every.where("low = high")
    counts = single.select("fp", F.col("low").alias("second"), "n")
    found = _materialised(rows, single.where("width > 1"), most_words, bits, held)
    collided = every.where("low <> high")
    if not collided.isEmpty():
        again = held.write(_recounted(rows, collided, most_words, bits).where(F.col("n") >= least), "recounted")
        counts = counts.unionByName(again.select("fp", "second", "n"))
        found = found.unionByName(again.where("contains(phrase, ' ')").select(*found.columns))
    phrases = held.write(_parts(found, bits), "phrases")
    asked = phrases.select("fp", "second", F.explode("cuts").alias("c")).select(F.col("fp").alias("_fp"), F.col("second").alias("_second"), "c.*")
    met = asked.join(held.write(counts, "counts").withColumnRenamed("n", "_count"), ["fp", "second"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("_count")))
    cuts = met.groupBy("_fp", "_second", "k").agg(side(0).alias("l"), side(1).alias("r"))
    cuts = cuts.join(phrases.select(F.col("fp").alias("_fp"), F.col("second").alias("_second"), F.col("n").alias("a")), ["_fp", "_second"])
    exact = lambda c: f"cast({c} as decimal(38,0))"
    cuts = cuts.withColumn("score", F.expr(f"{exact('a')} * a * 1000000 div ({exact('l')} * r)"))
    scored = cuts.groupBy("_fp", "_second").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    longer = phrases.select("n", F.explode("inner").alias("i")).groupBy("i.fp", "i.second").agg(F.max("n").alias("_longer"))
    kept = phrases.select("fp", "second", "lang", "phrase", F.col("n").alias("a")).join(longer, ["fp", "second"], "left").where(F.coalesce(100 * F.col("_longer") < covered_percent * F.col("a"), F.lit(True)))
    kept = kept.join(scored, (kept["fp"] == scored["_fp"]) & (kept["second"] == scored["_second"])).join(totals, "lang")
    kept = held.write(kept.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_words").alias("n"), F.col("_cut.score").alias("score")), "scored")
    out = materialize(_ranked(kept, top, held).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    held.clear()
    return out
