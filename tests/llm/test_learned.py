"""Learned and measured operators: brute force, held-out accuracy and edge cases."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duelgrid.llm import ctw, lmscore, weaklabel
from duelgrid.llm.langid import LanguageFilters, fit_filters, predict_language
from duelgrid.llm.lmscore import score_texts
from duelgrid.llm.queries import held_out, op4_language, op6_repetition, op8_quality
from duelgrid.llm.repetition import measure, repetition_quality
from duelgrid.llm.weaklabel import LABELLERS, estimate_accuracies, fit_scorer, read_text, score_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "1234 !!"), (5, "\U0001f600 é ß"), (5, "\U0001f600 é ß"), (6, "mot " * 30_000), (7, "x")]


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = op4_language(spark, sf).join(docs, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_edges(table):
    docs = table([(i, t, lang) for i, (t, lang) in enumerate([("the quick brown fox and the dog", "en"), ("der schnelle braune fuchs und der hund", "de")] * 5)] + [(20, "the dog and the fox", None)])
    filters = fit_filters(docs, F.lit(True))
    assert filters.langs == ["de", "en"]
    found = {r.doc_id: (r.lang_pred, r.score) for r in predict_language(table([*ODD, (8, "and the brown dog"), (9, "und der hund")]), filters, [F.col("doc_id")]).collect()}
    for i in (1, 2, 3, 4):
        assert found[i] == ("und", 0.0)
    assert found[8][0] == "en" and found[9][0] == "de" and all(0 <= s <= 1 for _, s in found.values())
    assert predict_language(table([]), filters, [F.col("doc_id")]).count() == 0
    none = fit_filters(table([]), F.lit(True))
    assert none.predict("text") == ("und", 0.0)


def test_more_languages_than_a_plane_holds(table):
    rng = random.Random(4)
    own = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)] for _ in range(20)]
    text = lambda i: " ".join(rng.choices(own[i], k=40))
    filters = fit_filters(table([(i, text(i % 20), f"l{i % 20:02}") for i in range(200)]), F.lit(True))
    assert filters.planes.shape == (3, 1 << 20) and len(filters.langs) == 20
    assert all(filters.predict(text(i))[0] == f"l{i:02}" for i in range(20))
    # brute force: grams are exact sets here, for no filter is full
    assert filters.false_rate.max() < 1e-6


def test_false_positives_are_corrected():
    bits = np.zeros(1 << 20, np.uint8)
    bits[::2] |= 1
    filters = LanguageFilters(["a", "b"], (bits | 2)[None])
    assert filters.false_rate[0] == pytest.approx(0.125) and filters.false_rate[1] == 1.0


def brute_measure(text):
    text = text or ""
    words = WORD.findall(text)
    five = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if five[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(marked)


def test_repetition_against_brute_force():
    rng = random.Random(6)
    for n in [0, 1, 4, 5, 6, 9, 40, 300]:
        for size in (2, 5, 300):
            text = "".join(f"{rng.choice(['wé', 'x', '##', 'long'])}{rng.randrange(size)}{rng.choice([' ', chr(10), '  ', chr(9)])}" for _ in range(n))
            assert measure(text)[:5] == brute_measure(text)
    words = [f"u{i}" for i in range(50)]
    shares = measure(" ".join(words + words))[-1]
    assert all(s == pytest.approx(0.5) for s in shares[3:])
    assert not any(measure(" ".join(f"v{i}" for i in range(300)))[-1])


def brute_verdict(text):
    """The verdict by whole n-grams, lines and characters, without hashes or arrays."""
    words, lines = WORD.findall(text), [line for line in text.split("\n") if WORD.search(line)]
    total, held = sum(map(len, words)), Counter(lines)
    repeats, seen = [], set()
    for line in lines:
        if line in seen:
            repeats.append(line)
        seen.add(line)
    size = lambda line: len(line.encode())
    good = len(repeats) <= 0.3 * max(len(lines), 1) and sum(map(size, repeats)) <= 0.2 * max(sum(map(size, lines)), 1) and held is not None
    good = good and sum(c in "#*$%&|<>" for c in text) <= 0.1 * max(len(words), 1)
    for width, limit in ((2, 0.2), (3, 0.18), (4, 0.16), (5, 0.2), (6, 0.19), (8, 0.17), (10, 0.15)):
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        times, found, marked = Counter(grams), set(), set()
        top = next((g for g in grams if times[g] == max(times.values())), None)
        for i, g in enumerate(grams):
            if (times[g] > 1 and g == top) if width < 5 else g in found:
                marked.update(range(i, i + width))
            found.add(g)
        good = good and (not total or sum(len(words[j]) for j in marked) / total <= limit)
    return good


def test_verdict_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = op6_repetition(spark, sf).collect()
    assert len(found) == len(texts) and {r.kept for r in found} == {True, False}
    for r in found:
        assert r.kept == (not r.base_failed and brute_verdict(texts[r.doc_id] or "")), r.doc_id


def test_quality_against_plain_steps(spark):
    """Votes of every row, expectation-maximisation over rows one by one, and a scorer at the minimum of its loss."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in op8_quality(spark, sf).collect()}
    read = {i: read_text(t) for i, t in texts.items()}
    votes = {i: r[0] for i, r in read.items()}
    chance = {i: 0.1 if "0" in v else 0.9 if "1" in v else 0.5 for i, v in votes.items()}
    for _ in range(200):
        prior = sum(chance.values()) / len(chance)
        table = [[{v: 1.0 + sum((chance[i] if good else 1 - chance[i]) for i, vs in votes.items() if vs[j] == v) for v in "10-"} for j in range(len(LABELLERS))] for good in (True, False)]
        # the prior of the round before goes with the tables of this one
        share = lambda good, j, v: table[0 if good else 1][j][v] / sum(table[0 if good else 1][j].values())
        logs = {vs: math.log(prior / (1 - prior)) + sum(math.log(share(True, j, v) / share(False, j, v)) for j, v in enumerate(vs)) for vs in set(votes.values())}
        chance = {i: 1 / (1 + math.exp(-max(-500, min(500, logs[vs])))) for i, vs in votes.items()}
    assert all(found[i].votes == votes[i] and found[i].posterior == pytest.approx(chance[i], abs=1e-6) for i in texts)
    weights = fit_scorer([(r[1], r[2], chance[i], 1) for i, r in sorted(read.items())], rounds=3000)
    slope = np.zeros_like(weights)
    for i, (_, buckets, values) in read.items():
        margin = weights[-1] + sum(weights[b] * v for b, v in zip(buckets, values))
        miss = (1 / (1 + math.exp(-margin)) - chance[i]) / len(read)
        slope[-1] += miss
        np.add.at(slope, buckets, np.multiply(values, miss))
        if buckets:
            assert found[i].score == pytest.approx(1 / (1 + math.exp(-margin)), abs=0.05) and found[i].kept == (found[i].score >= 0.3)
        else:
            assert found[i].score == 0 and not found[i].kept
    slope[:-1] += 1e-4 * weights[:-1]
    assert np.abs(slope).max() < 1e-4


def test_quality_of_many_copies(table):
    """Copies without ids count as many times as they occur, but are read once for the fit."""
    rows = [(None, "one text that is copied " * 8)] * 300 + [(i, f"word{i} " * 30) for i in range(20)]
    found = score_quality(table(rows), fit_rows=50).collect()
    assert len(found) == 320 and len({r.score for r in found if r.doc_id is None}) == 1


def test_repetition_edges(table):
    found = {r.doc_id: r for r in repetition_quality(table(ODD)).collect()}
    assert found[1].n_words == found[2].n_words == found[3].n_words == 0 and found[6].n_repeat_words == 30_000
    assert repetition_quality(table(ODD)).count() == len(ODD) and repetition_quality(table([])).count() == 0


def test_repetition_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = op6_repetition(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert found.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.99


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rates = {r.quality: r.kept for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.15


def test_quality_edges(table):
    found = {r.doc_id: r for r in score_quality(table(ODD)).collect()}
    assert len(found) == 7 and not found[1].kept and found[2].score == 0.0
    assert score_quality(table([])).count() == 0
    assert read_text(None)[0] == "-" * len(LABELLERS)
    assert estimate_accuracies({}) == ({}, {}) and not fit_scorer([]).any()


def test_accuracies_of_planted_labellers():
    rng = random.Random(11)
    counts = Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        votes = ""
        for right in (0.95, 0.9, 0.85):
            says = good if rng.random() < right else not good
            votes += "-" if rng.random() < 0.2 else "1" if says else "-" if rng.random() < 0.1 else "0"
        counts[votes] += 1
    posterior, accuracy = estimate_accuracies(dict(counts))
    assert posterior["111"] > 0.95 and posterior["000"] < 0.05
    assert accuracy[LABELLERS[0]] > accuracy[LABELLERS[2]]


def kt(a, b):
    out = 0.0
    for n, total in ((a, 0), (b, a)):
        for i in range(n):
            out += math.log((i + 0.5) / (total + i + 1))
    return out


def nodes_of(byte):
    return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]


class NaiveTree:
    """Context-tree weighting as defined: a dictionary of counts for each context and node, recursion, no arrays."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, Counter()
        for text in texts:
            for context, byte in self.steps(text):
                for node, bit in nodes_of(byte):
                    for d in range(depth + 1):
                        self.counts[context[depth - d :], node, bit] += 1
        self.seen = {(c, n) for c, n, _ in self.counts}
        self.children = {}
        for c, n in self.seen:
            if c:
                self.children.setdefault((c[1:], n), []).append((c, n))
        self.logs = {}

    def steps(self, text):
        data = bytes([ctw.END]) * self.depth + ctw.text_bytes(text)
        return [(data[i - self.depth : i], data[i]) for i in range(self.depth, len(data))]

    def direct(self, at):
        return kt(self.counts[(*at, 0)], self.counts[(*at, 1)])

    def weighted(self, at):
        if at not in self.logs:
            own = self.direct(at)
            self.logs[at] = own if len(at[0]) == self.depth else np.logaddexp(own, sum(map(self.weighted, self.children[at]))) - math.log(2)
        return self.logs[at]

    def chance(self, context, node):
        free, held = 1.0, 0.0
        known = [d for d in range(self.depth + 1) if (context[self.depth - d :], node) in self.seen]
        for d in known:
            at = (context[self.depth - d :], node)
            a, b = self.counts[(*at, 0)], self.counts[(*at, 1)]
            stop = 1.0 if d == known[-1] else math.exp(self.direct(at) - math.log(2) - self.weighted(at))
            held, free = held + free * stop * (b + 0.5) / (a + b + 1), free * (1 - stop)
        return held if known else 0.5

    def score(self, text):
        out = 0.0
        for context, byte in self.steps(text):
            for node, bit in nodes_of(byte):
                one = self.chance(context, node)
                out += math.log10(one if bit else 1 - one)
        return out


@pytest.mark.parametrize("most_keys", [1 << 20, 12, 0])
def test_scores_against_a_naive_tree(table, most_keys):
    rng = random.Random(9)
    vocabulary = ["ba", "lo", "Rin", "té", "kamo", "\U0001f600"]
    rows = [(i, " ".join(rng.choices(vocabulary, range(1, 7), k=rng.randrange(0, 25)))) for i in range(40)] + [(90, None), (91, "unseen zebra"), (91, "unseen zebra"), (92, "lo lo " * 300)]
    found = score_texts(table(rows), F.col("doc_id") % 3 != 0, depth=3, most_keys=most_keys).toPandas()
    naive = NaiveTree([t for i, t in rows if i % 3], 3)
    wanted = {i: naive.score(t) for i, t in rows}
    assert len(found) == len(rows)
    for r in found.itertuples():
        assert r.score == pytest.approx(wanted[r.doc_id], rel=1e-5, abs=1e-6)
    # the chances of all bytes after a context add up to one
    assert sum(10 ** sum(math.log10(naive.chance(b"lo ", n) if bit else 1 - naive.chance(b"lo ", n)) for n, bit in nodes_of(byte)) for byte in range(256)) == pytest.approx(1)


def test_texts_longer_than_a_piece():
    texts = [ctw.text_bytes("abcdefghij" * 3), ctw.text_bytes(""), ctw.text_bytes("xyz")]
    whole = ctw.contexts(next(ctw.pieces(texts, 4)), 4)
    for size in (1, 3, 7, 31):
        parts = [ctw.contexts(batch, 4) for batch in ctw.pieces(texts, 4, size)]
        assert all((np.concatenate([p[i] for p in parts]) == whole[i]).all() for i in (0, 1))


def test_key_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000))
    held = ctw.KeyTable(keys[::2], np.arange(len(keys[::2])) + 1.0)
    there, values = held.find(keys)
    assert there[::2].all() and not there[1::2].any() and (values[::2] == np.arange(len(keys[::2])) + 1).all()
    assert not ctw.KeyTable(np.zeros(0, np.int64), np.zeros(0)).find(keys)[0].any()


def peak_mb(work):
    """The most that Python and numpy hold at once while `work` runs."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("rows, words", [(8000, 300), (2, 1_200_000)])
def test_workers_hold_little(rows, words):
    """Counting and looking up keys works on pieces, whatever the size of the Arrow batch or of a text (16 MB here)."""
    tasks = []

    class Rows:
        def mapInArrow(self, work, schema):
            tasks.append(work)
            raise InterruptedError

    with pytest.raises(InterruptedError):
        lmscore.count_contexts(Rows(), 5)
    rng = random.Random(1)
    vocabulary = [f"{a}{b}" for a in ("ba", "lo", "rin", "te") for b in ("ka", "mo", "s", "ündig")]
    texts = [" ".join(rng.choices(vocabulary, k=words)) for _ in range(rows)]
    part = pa.record_batch([pa.array([None, *texts])], names=["_text"])
    found = Counter()

    def count():
        for batch in tasks[0](iter([part.slice(0, 1), part.slice(1)])):
            assert batch.num_rows <= 1 << 17
            for key, n in zip(*(c.to_pylist() for c in batch.columns)):
                found[key] += n

    # the array of keys, a text as str and bytes
    assert peak_mb(count) < 130
    assert sum(found.values()) == sum(len(t.encode()) + 1 for t in texts) + 1
    body = [ctw.text_bytes(t) for t in texts]
    held = ctw.KeyTable(np.array(list(found)), np.arange(len(found)))
    assert ctw.KeyTable.of(held.keys, held.values).bits == held.bits
    there = []
    assert peak_mb(lambda: there.extend(held.find(ctw.contexts(batch, 5)[1])[0].all() for batch in ctw.pieces(body, 5))) < 40
    assert all(there)


def test_scores_against_brute_force(table):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("Ba", "lo", "rin", "TE") for b in ("ka", "mo", "s", "ündig")]
    rows = [(i, " ".join(rng.choices(vocabulary, range(1, 17), k=rng.randrange(1, 80)))) for i in range(200)] + [(500, None), (501, ""), (502, "unseen words"), (502, "unseen words")]
    docs = table(rows)
    found = score_texts(docs, ~held_out(7), depth=3).withColumn("held_out", held_out(7)).toPandas().set_index("doc_id")
    out = found.held_out[~found.index.duplicated()]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    counts = Counter()
    for i, t in rows:
        if not out[i]:
            counts.update([*WORD.findall(lower(t)), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*WORD.findall(lower(t)), "\n"]
        got = found.loc[[i]].iloc[0]
        assert got.n_tokens == len(tokens) and got.train_tokens == total and got.n_known == sum(counts[w] > 0 for w in tokens)
        assert got.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens), abs=1e-9)
        assert got.score < 0
    assert len(found) == len(rows)
    fresh = found[found.held_out & (found.n_tokens > 10)]
    assert fresh.bits_per_byte.mean() < 3
    assert score_texts(table([]), F.lit(True), depth=2).count() == 0
    alone = score_texts(table([(1, "ab")]), F.lit(False), depth=2).first()
    assert alone.score == pytest.approx(-3 * 8 * math.log10(2), abs=1e-4)


def test_shape_reads_whole_words():
    # what follows the first 64 characters counts too
    long = "a" * 100
    assert weaklabel._shape(long) == "a" and weaklabel._shape(long + "7b") == "a0a"
    assert weaklabel.read_text(long)[0] != weaklabel.read_text(long + "7" + long)[0]


def test_language_against_plain_sets(spark, sf):
    """The whole query against sets of grams, without filters, bits or corrections: the same languages, nearly the same scores."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    train = [(text, lang) for i, text, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    sizes, docs = Counter(lang for _, lang in train), defaultdict(Counter)
    plain = lambda text: "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in (text or "").lower())

    def plain_grams(text):
        body = (" " + " ".join(x for x in plain(text).split(" ") if x) + " ").encode()
        return [body[i : i + 4] for i in range(len(body) - 3)]

    for text, lang in train:
        docs[lang].update(set(plain_grams(text)))
    shares = defaultdict(dict)
    for lang, counts in docs.items():
        for gram, n in counts.items():
            if n / sizes[lang] >= 0.004:
                shares[gram][lang] = n / sizes[lang]
    held = {lang: {g for g, s in shares.items() if lang in s and s[lang] >= 0.35 * max(s.values())} for lang in sizes}
    found = {r.doc_id: r for r in op4_language(spark, sf).collect()}
    assert len(found) == len(rows)
    same = close = judged = 0
    for i, text, _ in rows:
        hits = {lang: sum(g in held[lang] for g in plain_grams(text)) for lang in sorted(held)}
        if sum(hits.values()) >= 100:
            judged += 1
            best = max(hits, key=lambda x: hits[x])
            same += found[i].lang_pred == best
            close += abs(found[i].score - hits[best] / sum(hits.values())) < 0.02
    assert judged > 100 and same >= 0.99 * judged and close >= 0.97 * judged
