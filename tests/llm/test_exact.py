"""Exact operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from duelgrid.llm import decontaminate
from duelgrid.llm.components import connected_components
from duelgrid.llm.decontaminate import best_occurrence, find_benchmark, normalise, pieces
from duelgrid.llm.linededup import dedup_lines
from duelgrid.llm.mixing import SEED, draw_counts, mix_sources, permute, plan_mix
from duelgrid.llm.positions import running_positions
from duelgrid.llm.sharding import assign_shards
from duelgrid.llm.simhash import CODE, anchors, covering_words, near_duplicate_components, syndromes
from duelgrid.llm.simhash_bits import fingerprint
from duelgrid.llm.urlfilter import filter_urls

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Zwei\nLINES of text here\n"), (4, "Zwei\nLINES of text here\n"), (5, "word " * 30_000), (6, "\U0001f600 é ß"), (7, "x")]


def words(n, seed, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# --- sharding -----------------------------------------------------------------------------------------------------


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > middle:
                used, held = used + 1, 0
            held += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def test_shards_are_minimax_and_keep_copies_together(spark, table):
    rng = random.Random(4)
    texts = [words(rng.randrange(1, 60), i) for i in range(300)]
    rows = [(i, rng.choice(texts[:5]) if i % 3 == 0 else texts[i % 300]) for i in range(900)]
    docs = table(rows)
    found = assign_shards(docs, 7).toPandas()
    assert sorted(found.doc_id) == list(range(900))
    by_id = dict(rows)
    homes = defaultdict(set)
    for r in found.itertuples():
        homes[by_id[r.doc_id]].add(r.shard)
        assert r.text_crc32 == zlib.crc32(by_id[r.doc_id].encode()) and r.size == len(by_id[r.doc_id].encode()) + 8
    assert all(len(h) == 1 for h in homes.values())
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    keyed = docs.selectExpr("xxhash64(text) AS k", "octet_length(text) + 8 AS s").groupBy("k").agg({"s": "sum"}).orderBy("k").collect()
    assert found.groupby("shard")["size"].sum().max() <= smallest_capacity([r[1] for r in keyed], 7)
    again = assign_shards(docs.repartition(5), 7).toPandas()
    assert found.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_shards_of_odd_tables(table):
    found = assign_shards(table(ODD), 24).toPandas()
    assert len(found) == len(ODD) and found[found.doc_id == 1]["size"].iloc[0] == 8 and pd.isna(found[found.doc_id == 1].text_crc32.iloc[0])
    assert assign_shards(table([]), 24).count() == 0
    assert set(assign_shards(table([(i, "same") for i in range(50)]), 24).toPandas().shard) == {0}


def test_running_positions(spark):
    rows = spark.createDataFrame([(i % 2, i, i % 5) for i in range(400)], "g int, i int, w int")
    found = running_positions(rows, ["g"], ["i"], "w", cells=16).toPandas()
    for _, part in found.groupby("g"):
        part = part.sort_values("_pos")
        assert list(part._pos) == list(range(200))
        assert list(part._start) == list(np.cumsum(part.w) - part.w)


def test_running_positions_of_repeated_rows(spark):
    """A row that makes up a third of the table, null values, and other columns: no position twice, the same ones again."""
    rows = [(0, 7, "x", 3, "p")] * 500 + [(0, i, None, i % 4, "q") for i in range(700)] + [(1, None, None, 2, "r")] * 40 + [(1, i, "y", 1, "s") for i in range(60)]
    frame = spark.createDataFrame(rows, "g int, i int, t string, w int, extra string")
    found = running_positions(frame, ["g"], ["i", "t"], "w", cells=16).toPandas()
    assert len(found) == len(rows) and set(found.columns) == {"g", "i", "t", "w", "extra", "_pos", "_start"}
    for _, part in found.groupby("g"):
        part = part.sort_values("_pos")
        assert list(part._pos) == list(range(len(part))) and list(part._start) == list(np.cumsum(part.w) - part.w)
    again = running_positions(frame.repartition(7), ["g"], ["i", "t"], "w", cells=16).toPandas()
    ordered = lambda df: df.sort_values(["g", "_pos"]).fillna("-").values.tolist()
    assert ordered(found) == ordered(again)
    assert running_positions(frame.limit(0), ["g"], ["i"]).count() == 0


# --- lines --------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(" \t\n\x0b\x0c\r")
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not (len(holders.get(key(line), ())) >= 2 and min(holders[key(line)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_against_brute_force(table):
    rng = random.Random(2)
    pool = [words(3, i, 30) for i in range(25)] + ["short", "", "  Padded Line HERE \t", "padded line here", "ÄÖÜ äöü long line", "x" * 9, "y" * 10]
    rows = [(i, None if i % 17 == 0 else "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 8)))) for i in range(120)]
    found = sorted(tuple(r) for r in dedup_lines(table(rows)).collect())
    assert found == brute_lines(rows)


def test_line_dedup_odd(table):
    found = sorted(tuple(r) for r in dedup_lines(table(ODD)).collect())
    assert found == sorted((i, len((t or "").split("\n")), 0, t or "") for i, t in ODD)
    assert dedup_lines(table([])).count() == 0
    hot = [(i, "the very common line\nown %d line text" % i) for i in range(300)]
    assert sorted(r.n_dropped for r in dedup_lines(table(hot)).collect()) == [0] + [1] * 299
    three = sorted((r.doc_id, r.n_dropped) for r in dedup_lines(table([(1, "shared by two"), (2, "shared by two"), (3, "shared by three\nx"), (4, "shared by three"), (5, "shared by three")]), min_docs=3).collect())
    assert three == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
    # rows that repeat an id are one document, whatever the threshold
    again = [(1, "a line in two"), (1, "a line in two"), (1, "a line in two"), (2, "a line in two")]
    assert [r.n_dropped for r in dedup_lines(table(again), min_docs=3).collect()] == [0] * 4
    assert sorted((r.doc_id, r.n_dropped) for r in dedup_lines(table(again)).collect()) == [(1, 0)] * 3 + [(2, 1)]
    assert [r.n_dropped for r in dedup_lines(table(again[:2])).collect()] == [0, 0]
    assert sorted((r.doc_id or 0, r.n_dropped) for r in dedup_lines(table([(None, "a line in two"), (1, "a line in two")])).collect()) == [(0, 0), (1, 1)]


# --- near-duplicates ------------------------------------------------------------------------------------------------


def test_hamming_code_covers_with_radius_one():
    values = np.random.default_rng(0).integers(0, 1 << CODE, 2000).astype(np.uint64)
    rows, words = covering_words(values, CODE, 2)
    assert not syndromes(words).any() and not syndromes(covering_words(values, CODE, 1)[1]).any()
    for i in range(5):
        flips = [0] + [1 << a for a in range(CODE)] + [1 << a | 1 << b for a in range(CODE) for b in range(a)]
        wanted = {int(values[i]) ^ f for f in flips}
        assert {int(w) for w in words[rows == i]} == {w for w in wanted if not syndromes(np.array([w], np.uint64))[0]}


def test_homes_meet_replicas_of_all_near_fingerprints():
    rng = np.random.default_rng(1)
    marks = rng.integers(-(2**63), 2**63, 300)
    for bits in (0, 1, 2, 3):
        flips = np.zeros(len(marks), np.uint64)
        for i in range(len(marks)):
            for at in rng.choice(64, bits, replace=False):
                flips[i] |= np.uint64(1) << np.uint64(at)
        homes = Counter(zip(*(a.tolist() for a in anchors(marks, bits, 1))))
        replicas = set(zip(*(a.tolist() for a in anchors(marks ^ flips.view(np.int64), bits, 2))))
        assert {i for i, _ in set(homes) & replicas} == set(range(len(marks)))
    at, _ = anchors(marks, 2, 2)
    assert np.bincount(at).max() <= 3 * 28


def brute_components(rows, width, bits):
    marks = {i: fingerprint(t, width) & (2**64 - 1) for i, t in rows}
    ids, root = sorted(marks), {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(table):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = words(rng.randrange(5, 250), i).split()
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(99)}"
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(5000 + i, t) for i, t in ((0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "a b"), (6, "A  B"))]
    for width, bits in ((3, 2), (3, 3), (5, 0)):
        found = {r.doc_id: r.component_id for r in near_duplicate_components(table(rows), width, bits).collect()}
        assert found == brute_components(rows, width, bits)


def test_near_duplicate_edges(table):
    assert near_duplicate_components(table([])).count() == 0
    found = near_duplicate_components(table(ODD)).collect()
    assert len(found) == len(ODD)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    copies = [(i, words(80, 1)) for i in range(200)] + [(900, words(80, 2))]
    assert {r.component_id for r in near_duplicate_components(table(copies)).collect()} == {0, 900}


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "u long, v long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert connected_components(edges.limit(0)).count() == 0


# --- decontamination ------------------------------------------------------------------------------------------------


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        wanted = edit_distance_in(pattern, text)
        for budget in (0, 3, 200):
            found = best_occurrence(pattern, text, budget)
            # the empty match (all deleted) is not looked for before any text was read
            assert (found[0] if found else None) == (wanted if wanted <= budget and text else None)


def test_pieces_cover_the_item():
    for n, k in ((10, 3), (95, 5), (3, 7)):
        item = "".join(chr(97 + i % 26) for i in range(n))
        assert "".join(p for _, p in pieces(item, k)) == item


def test_find_benchmark(spark, table):
    items = [words(30, i, 90) for i in range(12)]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "short")], "item_id long, text string")
    edited = items[3].replace("w", "v", 4)
    far = "".join(c if i % 4 else "#" for i, c in enumerate(items[4]))
    rows = [(1, f"{words(50, 99)} {items[0].upper()} tail"), (2, items[1].replace(" ", "\n ")), (3, f"a {edited} b"), (4, far), (5, None), (6, ""), (7, words(3000, 77)), (8, items[2] + " " + items[5]), (8, items[2] + " " + items[5]), (9, "short")]
    for block in (10**9, 300):
        found = sorted((r.doc_id, r.item_id, r.distance) for r in find_benchmark(table(rows), bench, block_chars=block).collect())
        assert found == [(1, 0, 0), (2, 1, 0), (3, 3, 4), (8, 2, 0), (8, 2, 0), (8, 5, 0), (8, 5, 0)]
    assert find_benchmark(table(rows), bench.limit(0)).count() == 0
    assert find_benchmark(table([]), bench).count() == 0


def test_find_benchmark_against_brute_force(spark, table):
    """Every document against every item by dynamic programming."""
    rng = random.Random(12)
    items = [(i, words(rng.randrange(6, 14), 500 + i, 40)) for i in range(8)]
    rows = []
    for i in range(60):
        text = words(rng.randrange(0, 30), i, 40)
        if i % 2:
            item = list(items[i % 8][1])
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], ["x"], [item[at], "y"]])
            text = f"{text} {''.join(item)} {words(4, 900 + i, 40)}"
        rows.append((i, text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in find_benchmark(table(rows), bench).collect()}
    wanted = {}
    for i, text in rows:
        for n, item in items:
            distance = edit_distance_in(normalise(item), normalise(text))
            if distance <= int(len(normalise(item)) * 0.06):
                wanted[i, n] = distance
    assert found == wanted and len(wanted) >= 10 and max(wanted.values()) > 0


def test_short_and_repeated_items(spark, table, monkeypatch):
    long = words(30, 5, 90)
    bench = spark.createDataFrame([(1, "Is it so?"), (2, long), (4, ""), (5, None), *((100 + i, long) for i in range(40))], "item_id long, text string")
    rows = [(1, "He said: is  it so? No."), (2, "this it so? is it sober"), (3, f"a {long} b"), (4, "is it so")]
    sent, share = [], decontaminate.share
    monkeypatch.setattr(decontaminate, "share", lambda session, value: sent.append(value) or share(session, value))
    found = sorted((r.doc_id, r.item_id, r.distance) for r in find_benchmark(table(rows), bench, short_items=True).collect())
    assert found == [(1, 1, 0), *((3, i, 0) for i in [2, *range(100, 140)])]
    # each text travels once, however many items share it
    assert sum(len(text) for block in sent for _, text in block.items) <= len(long) + len("Is it so?")


# --- mixing ---------------------------------------------------------------------------------------------------------


def targets(spark, sizes):
    """Words of each source's target, with weights 3, 1, 2 repeating."""
    sized = spark.createDataFrame([(i, f"s{i:03}", n) for i, n in enumerate(sizes)], "_id long, _source string, _size long")
    return [r.target for r in plan_mix(sized, 64, 1.5, 2.0).orderBy("_number").collect()]


def brute_targets(sizes):
    left, free, found = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = left / sum([3, 1, 2][i % 3] for i in free)
        over = {i for i in free if unit * [3, 1, 2][i % 3] > 2 * sizes[i]}
        for i in over or free:
            found[i] = 2.0 * sizes[i] if over else unit * [3, 1, 2][i % 3]
        left -= sum(found[i] for i in over)
        free = free - over if over else set()
    return found


def test_targets(spark):
    assert targets(spark, [100, 100]) == pytest.approx([200, 100])
    found = targets(spark, [10, 1000, 500])
    assert found[0] == 20 and sum(found) == pytest.approx(1.5 * 1510)
    rng = random.Random(5)
    for sizes in ([0, 5, 9, 0], [rng.randrange(1, 10 ** rng.randrange(1, 7)) for _ in range(50)]):
        assert targets(spark, sizes) == pytest.approx(brute_targets(sizes))


def test_draws_add_up_and_permutations_are_permutations():
    counts = draw_counts(977, 24, [5, 1])
    assert counts.sum() == 977 and counts.min() >= 0 and draw_counts(0, 24, [5, 1]).sum() == 0
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 1, 12345):
            image = permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(image) == list(range(n))
    assert list(permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1))) != list(permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2)))


def test_mix(table):
    rng = random.Random(3)
    rows = [(i, words(rng.randrange(0, 200), i) if i % 11 else None, "en", None if i % 7 == 0 else f"s{min(i % 9, 4)}") for i in range(400)]
    docs = table(rows)
    found = mix_sources(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(found.doc_id) == list(range(400))
    assert [len((r[1] or "").split()) for r in rows] == list(found["size"])
    assert (found.taken <= 2 * found["size"]).all() and (found.taken >= 0).all()
    sums = found.assign(source=[r[3] or "~" for r in rows]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums.taken - sums.target) <= 64 + 0.02 * sums.target).all()
    assert sums.target.sum() == pytest.approx(1.5 * found["size"].sum())
    again = mix_sources(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert again.equals(found)
    # a replay: the words of a source in hash order, blocks of 64, its slots through its permutations
    plan = {r["_source"]: r for r in plan_mix(docs.selectExpr("doc_id AS _id", "source AS _source", "size(regexp_extract_all(coalesce(text, ''), '\\\\S+', 0)) AS _size"), 64, 1.5, 2.0).collect()}
    cell = {r[0]: r[1] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, cast(size(regexp_extract_all(coalesce(text, ''), '\\\\S+', 0)) AS bigint)), 256)").collect()}
    for source, p in plan.items():
        stream = [i for i, _ in sorted(((r[0], len((r[1] or "").split())) for r in rows if r[3] == source), key=lambda x: (cell[x[0]], x)) for _ in range(len((rows[i][1] or "").split()))]
        j = np.arange(p.slots)
        blocks = permute(j % p.blocks, np.full(p.slots, p.blocks), j // p.blocks * 1_000_003 + p["_number"] * 7919 + SEED)
        taken = Counter(i for b in blocks.tolist() for i in stream[64 * b : 64 * b + 64])
        assert {r.doc_id: r.taken for r in found.itertuples() if rows[r.doc_id][3] == source and r.taken} == dict(taken)
    assert mix_sources(table([])).count() == 0
    many = mix_sources(table([(i, "a b c", "en", f"s{i}") for i in range(3000)])).toPandas()
    assert len(many) == 3000 and set(many.taken) <= {0, 3, 6}
    assert [r.taken for r in mix_sources(table([(1, None), (2, "")])).collect()] == [0, 0]
    assert len(mix_sources(table(ODD)).collect()) == len(ODD)


# --- URLs -----------------------------------------------------------------------------------------------------------


def brute_url(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host and blocked(host, path) else "allow"


def test_urls_against_brute_force(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = [None, "", "nope", "http://", "HTTP://WWW.Example.ORG/es/x?a=b", "https://example.org/en/12#f", "https://a.example.org/en/2", "http://xorg/es/", "http://org", "http://q.com/fr/1", "http://q.com/de", "http://q.com/de/1",
            "http://com/de/?x://y/fr/", "http://bad.net/p/", "http://www.bad.net:80/p.html", "http://bad.net/q", "http://a\nb.net/z", "ftp://bad.net/p", "http://bad.net/p"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    blocked = spark.createDataFrame([("bad.net/p",), (None,), ("bad.net/p",)], "key string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rules, blocked).collect()}
    names = {"bad.net/p", "www.bad.net:80/p.html", "bad.net/p/"}
    for i, url in enumerate(urls):
        assert found[i] == brute_url(url, rules, lambda h, p: h + p in names), url
    assert filter_urls(pages.limit(0), rules, blocked).count() == 0
    assert filter_urls(pages, rules, blocked.limit(0)).where("verdict = 'block' and rule is null").count() == 0


def test_kept_text_hash_matches(table):
    row = dedup_lines(table([(1, "a line that stays")])).selectExpr("sha2(kept_text, 256) AS h").first()
    assert row.h == hashlib.sha256(b"a line that stays").hexdigest()


def test_replicas_of_fingerprints_are_not_broadcast(spark):
    from duelgrid.llm.simhash import near_pairs

    rows = spark.createDataFrame([(0b1011,), (0b1000,), (0b111 << 40,)], "fp bigint")
    found = near_pairs(rows, 2)
    assert [tuple(r) for r in found.collect()] == [(0b1000, 0b1011)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
