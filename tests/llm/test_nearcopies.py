"""Near-duplicates by word shingles against all pairs, planted groups and odd rows."""

import random

import numpy as np
import pytest

from duelgrid.llm.nearcopies import BITS, DIFFERING, Windows, drop_near_duplicates, near_duplicate_groups


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else {()}


def brute_groups(rows, similarity=0.8):
    """{id: smallest id of its connected group} by comparing all pairs that share a shingle."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            both = len(sets[i] & sets[j]) if min(len(sets[i]), len(sets[j])) >= similarity * max(len(sets[i]), len(sets[j])) else 0
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def text(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def edited(base, edits, seed):
    rng, words = random.Random(seed), base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def dropped(frame):
    return {r["_id"]: r["component_id"] for r in near_duplicate_groups(frame).where("not kept").collect()}


def test_links_near_the_limit(table):
    rows = []
    for i in range(300):
        base = text(random.Random(i).randrange(60, 300), i)
        rows += [(3 * i, base), (3 * i + 1, edited(base, max(1, len(base.split()) // 60), i)), (3 * i + 2, text(80, 9000 + i))]
    truth, found = brute_groups(rows), dropped(table(rows))
    wanted = {i: c for i, c in truth.items() if i != c}
    assert set(found.items()) <= set(wanted.items()) and len(found) >= 0.97 * len(wanted) > 200


def test_large_groups(table):
    """Copies near one text but not each other, and a family without a center, beyond the size of a bucket."""
    base, other = text(120, 1), text(120, 2)
    rows = [(i, edited(base, 2, i)) for i in range(300)] + [(i, base) for i in range(300, 500)]
    rows += [(1000, other), (1001, edited(other, 1, 5)), (1002, text(120, 3))]
    family = text(150, 7)
    rows += [(2000 + i, edited(family, 3, 5000 + i)) for i in range(200)]
    truth, found = brute_groups(rows), dropped(table(rows))
    wanted = {i: c for i, c in truth.items() if i != c}
    missed = set(wanted) - set(found)
    assert set(found) <= set(wanted) and len(missed) <= 0.03 * len(wanted)
    assert found[1001] == 1000 and 1000 not in found and 1002 not in found


def test_odd_rows(table):
    assert near_duplicate_groups(table([])).count() == 0 and drop_near_duplicates(table([])).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one three"), (None, "one two"), (7, text(9000, 4)), (8, text(9000, 4) + " end"), (9, text(30, 5)), (9, text(30, 6))]
    assert dropped(table(rows)) == {2: 1, 3: 1, 5: 4, None: 4, 8: 7}
    kept = drop_near_duplicates(table(rows * 3))
    assert kept.columns == table([]).columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, ""), (4, "One two"), (6, "one three"), (7, text(9000, 4)), (9, text(30, 5)), (9, text(30, 6))] * 3)
    # without ids, and with one id for different texts, rows are told apart by their text
    rows = [(None, text(90, 1)), (None, text(90, 1) + " end"), (None, text(90, 2)), (5, text(90, 3)), (5, text(90, 3) + " end"), (5, text(90, 4))]
    kept = [(r.doc_id, r.text) for r in drop_near_duplicates(table(rows)).collect()]
    assert len(kept) == 4 and {rows[2], rows[5]} <= set(kept)
    # one dominant shingle in texts that share little else: both stay
    assert dropped(table([(1, "the " * 400 + text(100, 3)), (2, "the " * 400 + text(100, 4))])) == {}
    assert dropped(table([(i, text(80, 1)) for i in range(200)] + [(900, text(80, 2))])) == {i: 0 for i in range(1, 200)}


def test_extra_columns_stay(spark):
    names = ["_id", "_k1", "_user", "_text", "node", "s0", "kept", "component_id", "score"]
    frame = spark.createDataFrame([(1, "a b c d e f", *names), (2, "a b c d e f", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert [tuple(r) for r in drop_near_duplicates(frame).collect()] == [(1, "a b c d e f", *names)]


def test_meeting_probability():
    rng = np.random.default_rng(3)
    left = rng.integers(0, 2, (1000, BITS)).astype(np.uint8)
    # single changed words at a similarity of 0.8, and DIFFERING: the pairs that differ in more bits than the mean meet less often
    close, far = (left ^ (rng.random((1000, BITS)) < p) for p in (0.1, DIFFERING))
    for nodes, least in ((100, 0.9), (50_000, 0.88), (5_000_000, 0.83), (10**10, 0.76)):
        windows = Windows(nodes)
        a, b, c = windows.first(left), windows.first(close), windows.first(far)
        assert (a == b).any(axis=1).mean() > 0.94 and (a == c).any(axis=1).mean() > least
        assert (a == np.roll(a, 1, axis=0)).mean() < 2 / nodes + 0.0002


def shared_template(pairs, start):
    """Pairs of texts of 150 words, 100 of them the same in all; inside a pair three words differ."""
    template, rows = text(100, 77).split(), []
    for i in range(pairs):
        own = text(50, start + i).split()
        words = template[:40] + own[:25] + template[40:] + own[25:]
        changed = words.copy()
        for at in (45, 70, 140):
            changed[at] = f"c{at}x{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    return rows


@pytest.mark.parametrize("pairs", [400, 2500])
def test_links_in_crowded_buckets(table, pairs):
    """Nodes that share buckets with many others of no link to them: no link is lost for that."""
    rows = shared_template(pairs, 50_000)
    one, two = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.8 <= len(one & two) / len(one | two) < 0.85 and len(one & shingles(rows[2][1])) / len(one | shingles(rows[2][1])) < 0.6
    found = dropped(table(rows))
    assert set(found.items()) <= {(2 * i + 1, 2 * i) for i in range(pairs)} and len(found) >= 0.95 * pairs
