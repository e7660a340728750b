"""Spelling variants, phrases and embedding copies against brute force, and their odd cases."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from duelgrid.llm import phrases, queries, spelling, vectors
from duelgrid.llm.bloom import build
from duelgrid.llm.flatgraph import roots
from duelgrid.llm.phrases import mine_phrases
from duelgrid.llm.spelling import count_words, spelling_variants
from duelgrid.llm.vectors import near_duplicate_vectors


def lowered(text):
    return (text or "").encode().lower().decode()


def brute_words(docs, every):
    counts = Counter()
    for name, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, least=5, ratio=5):
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def test_spelling_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted = brute_variants(brute_words(docs, 199))
    found = queries.op11_spelling(spark, sf).collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    assert sum(r.n_near > 0 for r in found) > 100


def test_spelling_chains_ties_and_odd_rows(spark, table):
    words = {"letters": 1000, "lettres": 2, "letterz": 100, "lettexz": 15, "lettexq": 3, "lettqxq": 5, "mètre-é": 9, "sameas": 30, "samebs": 30, "samecs": 6, "short": 50, "l" * 3000: 40, "l" * 3001: 7, "l" * 2999 + "m": 8}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    docs = [(1, text.upper().replace("È", "è").replace("É", "é")), (2, None), (None, "Letters letters"), (3, ""), (3, "123 \0 !"), (4, "letters" * 1), (4, "letters")]
    found = spelling_variants(count_words(table(docs), 6))
    rows = {r.word: tuple(r) for r in found.collect()}
    assert set(rows.values()) == brute_variants(brute_words([(d[0], d[1]) for d in docs], None))
    assert rows["lettqxq"][1] is None and rows["lettexz"][1:3] == ("letterz", "letters") and rows["samecs"][1] == "sameas"
    assert rows["l" * 3001][1] == "l" * 3000 and rows["l" * 3001][4] == 1 and "short" not in rows
    assert spelling_variants(count_words(table([(1, None)]), 6)).count() == 0
    assert spelling_variants(count_words(table([]), 6)).count() == 0
    assert spelling_variants(spark.createDataFrame([("letters", 3, "x"), ("letters", 2, "y"), (None, 9, "z")], "word string, n long, h string")).collect() == [("letters", None, "letters", 5, 0, None)]


def test_spelling_in_several_broadcasts(spark, table, monkeypatch):
    docs = [(i, " ".join("abcdef" + "xyzuvw"[: (i * k) % 6] + "pqrs"[k % 4] for k in range(40))) for i in range(20)]
    monkeypatch.setattr(spelling, "MOST_BLOCKS", 1)
    found = spelling_variants(count_words(table(docs), 6))
    assert {tuple(r) for r in found.collect()} == brute_variants(brute_words(docs, None))


def test_bloom_misses_no_key(spark):
    keys = spark.range(20000).selectExpr("xxhash64(id) AS h", "cast(id % 3 as int) AS shard")
    made, rows = build(keys, 3), keys.toArrow()
    hashes, shards = rows["h"].to_numpy().view(np.uint64), rows["shard"].to_numpy()
    assert len(made.possible(hashes, shards)) == 20000
    assert len(made.possible(hashes + np.uint64(1), shards)) < 400


def brute_phrases(docs, most=3, top=2000, least=10, percent=50):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, c in counts.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in frequent.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    cover[p[i : i + n]] = max(cover[p[i : i + n]], a)
        rows = []
        for p, a in frequent.items():
            if not cover[p] or 100 * cover[p] < percent * a:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, words[lang], -score) for i, (score, a, p, left, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 9])
def test_phrases_against_brute_force(spark, sf, bits):
    """With nine bits nearly all fingerprints collide, and are counted by their text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = brute_phrases([(r.text, r.lang) for r in docs.collect()])
    assert sorted(tuple(r) for r in mine_phrases(docs, bits=bits).collect()) == wanted and len(wanted) > 100


def test_phrases_by_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = queries.op12_phrases(spark, sf)
    wanted = con.execute(queries.ORACLE_SQL["op12_phrases"])
    assert [d[0] for d in wanted.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())


def test_phrases_in_long_texts_and_odd_rows(spark, table, monkeypatch):
    """Stretches of words and spans of bytes end anywhere; a text is longer than a block, in all of which nothing is lost."""
    monkeypatch.setattr(phrases, "BYTES", 997)
    monkeypatch.setattr(phrases, "WORDS", 101)
    monkeypatch.setattr(phrases, "GRAMS", 1000)
    long = " ".join(f"W{i * i % 23} the\t of" + "." * (i % 7 == 0) for i in range(3000))
    docs = [(1, long, "en", None), (1, long, "en", None), (2, "Ünd à la " * 30, None, None), (3, None, "en", None), (4, "", None, None), (None, "a b\x0ba b\xa0c a b", "x y", None), (5, "..;\n \t", "de", None), (6, "a " * 40, "de", None)]
    for most in (2, 3, 5):
        found = mine_phrases(table(docs), most_words=most)
        assert sorted(tuple(r) for r in found.collect()) == brute_phrases([(d[1], d[2]) for d in docs], most)
    assert mine_phrases(table([])).count() == 0 and mine_phrases(table([(1, None), (2, " .")])).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    row = spark.sql("SELECT cast(9000000000000 as decimal(38,0)) * 9000000000000L * 1000000 div (cast(9000000000007 as decimal(38,0)) * 9000000000011L) AS s").first()
    assert row["s"] == 9000000000000**2 * 1000000 // (9000000000007 * 9000000000011)


def brute_links(rows, similarity):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [[j for j, (_, b) in enumerate(good) if j != i and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= similarity] for i, (_, a) in enumerate(good)]
    pairs = np.array([(i, j) for i, x in enumerate(links) for j in x], int).reshape(-1, 2)
    root = roots(len(good), pairs)
    least = {}
    for r, (i, _) in zip(root, good):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    out = [(i, len(x), least[r]) for (i, _), x, r in zip(good, links, root)]
    usable = Counter((i, tuple(v)) for i, v in good)
    for i, v in rows:
        key = (i, tuple(v)) if v and None not in v else None
        if usable[key] > 0:
            usable[key] -= 1
        else:
            out.append((i, 0, i))
    return sorted(((i, n, c, i == c) for i, n, c in out), key=str)


def planted(count, groups, dims=24, seed=3):
    """Vectors of which each group's are near one another, some in chains that only links by steps join."""
    random = np.random.default_rng(seed)
    rows = list(random.normal(size=(count, dims)))
    for g in range(groups):
        centre = random.normal(size=dims)
        rows += [centre + random.normal(size=dims) * (0.08 + 0.05 * (g % 3)) * np.linalg.norm(centre) / np.sqrt(dims) for _ in range(3 + 5 * g)]
    step = random.normal(size=dims)
    rows += [rows[0] + step * 0.2 * k for k in range(1, 12)]
    return rows


def test_vectors_against_brute_force_in_split_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 256)
    rows = [(i * 7 % 1009 + 1, list(map(float, v))) for i, v in enumerate(planted(600, 12))]
    rows += [(5000 + i, rows[-1][1]) for i in range(30)] + [rows[-1], rows[-1]]
    found = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    wanted = brute_links(rows, 0.95)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert [r[0] for r in got] == [r[0] for r in wanted]
    assert all(g[1] <= w[1] for g, w in zip(got, wanted))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in wanted)
    assert sum(g[2] == w[2] for g, w in zip(got, wanted)) >= 0.99 * len(wanted)


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, -0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 5.0]), (1, [1.0, 0.0]), (10, [1e300, 1e298]), (11, [-1.0, 0.0])]
    full = [(*r, 1, "x", 7) for r in rows]
    frame = spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, _id string, node long")
    found = {r for r in map(tuple, near_duplicate_vectors(frame).collect())}
    assert found == {(1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (None, 4, 1, False), (None, 0, None, True), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11))}
    assert near_duplicate_vectors(frame.limit(0)).count() == 0
    assert near_duplicate_vectors(frame.where("vec_id = 3")).collect() == [(3, 0, 3, True)]


def test_vectors_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = queries.op13_vectors(spark, sf)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_links(rows, 0.95)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings AS SELECT * FROM (VALUES (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, NULL), (4, [0.0, 0.0]), (5, [0.9, 0.25]), (6, [-1.0, 0.3])) t(vec_id, embedding)")
    pairs = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [0.9, 0.25]), (6, [-1.0, 0.3])]
    assert sorted(con.execute(queries.ORACLE_SQL["op13_vectors"]).fetchall(), key=str) == brute_links(pairs, 0.95)


def test_audit_counts_what_is_missed(spark):
    rows = [(i, [1.0, 0.001 * i], 1) for i in range(20)]
    classes = spark.createDataFrame(rows, "node long, vec array<double>, mult long")
    assert vectors.audit(classes, spark.createDataFrame([(i, 19) for i in range(10)], "node long, links long"), 0.95) == 0.5
    assert vectors.audit(classes.limit(1), spark.createDataFrame([], "node long, links long"), 0.95) == 1.0
