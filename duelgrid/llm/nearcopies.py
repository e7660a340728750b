"""Near-duplicates by word shingles: SimHash sketches meet at code words of covering codes, crowded ones by prefixes; texts decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.components import connected_components
from duelgrid.llm.simhash_bits import SEED, shingle_hashes
from duelgrid.llm.storage import Scratch, keep_possible, materialize

#: A sketch has 256 bits, held as four longs, of the text's pairs of words: a changed word changes two of them, but five
#: five-word shingles, so near-duplicates differ in fewer bits; other texts share few pairs.
WORDS, BITS, PAIR = 4, 256, 2
#: Part of a window's bits that one Hamming code (covering radius 1) covers; what is left over is taken bit by bit.
CODE, CODE_BITS = 15, 11
#: Anchor bits beyond the logarithm of the number of nodes, so that about half a node of another kind lies in a bucket.
SPARE_BITS = 1
#: Share of bits in which near-duplicates differ that windows are drawn for, and how often such texts are to meet. Texts of
#: similarity 0.8 differ in 10% if single words were changed, in 15% if a block was added.
DIFFERING, RECALL = 0.13, 0.95
#: Bits beyond which a pair isn't decided on its texts. A pair of similarity 0.8 differs in 38 on average at most, with a
#: deviation of 6; texts of ten words, in 49 at most. It exceeds the bound with a probability under 0.0001 (0.000001).
FAR = 72
#: Nodes of a bucket that are compared completely.
COMPLETE = 8
#: Bits of a bucket key that hold its window's number.
WINDOW_BITS = 14


def sketch(hashes: np.ndarray) -> np.ndarray:
    """256 bits of a set of shingle hashes, as four signed words: a bit is 1 if more than half of the hashes have it."""
    if not len(hashes):
        return np.zeros(WORDS, np.int64)
    ones = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        mixed = hashes[at : at + (1 << 14)].astype(np.uint64)
        for word in range(WORDS):
            ones[word] += np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0]


def nearest_code_word(values: np.ndarray) -> np.ndarray:
    """The word of the Hamming code of length CODE nearest to each value: its syndrome names the bit to flip."""
    wrong = np.zeros(values.shape, np.int64)
    for check in range(CODE.bit_length()):
        mask = sum(1 << (at - 1) for at in range(1, CODE + 1) if at >> check & 1)
        wrong |= (np.bitwise_count(values & mask) & 1).astype(np.int64) << check
    return np.where(wrong > 0, values ^ (np.int64(1) << np.maximum(wrong - 1, 0)), values)


class Windows:
    """Windows of the sketch for tables of `nodes` nodes: how many bits an anchor has, and how many windows there are.

    An anchor's bits follow the logarithm of the number of nodes, so that unrelated nodes in a bucket stay few at any
    size; the number of windows follows the bits, so that near-duplicates meet as often.
    """

    def __init__(self, nodes: int):
        bits = max(CODE_BITS, math.ceil(math.log2(max(nodes, 2))) + SPARE_BITS)
        self.codes, self.raw = divmod(bits, CODE_BITS)
        p, q = DIFFERING, 1 - DIFFERING
        # equal nearest words: no bit differs, or one or two do that fall to the same word in 2 of 16 cases
        same = q**CODE + (CODE * p * q ** (CODE - 1) + math.comb(CODE, 2) * p**2 * q ** (CODE - 2)) * 2 / (CODE + 1)
        meet = same**self.codes * q**self.raw
        self.count = min((1 << WINDOW_BITS) - 1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))
        self.orders = np.stack([np.random.default_rng([self.codes, self.raw, w]).permutation(BITS) for w in range(self.count)]).astype(np.int16)

    def key(self, window: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """One long of a window's number and a hash of the bucket so far with the next code word."""
        mixed = (parts.view(np.uint64) ^ (parts.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(WINDOW_BITS)).astype(np.int64) | (window.astype(np.int64) << (64 - WINDOW_BITS))

    def first(self, bits: np.ndarray) -> np.ndarray:
        """[row, window] bucket keys of rows of 256 bits: nearest code words of each window, and its single bits."""
        weights, at = 1 << np.arange(CODE, dtype=np.int64), 0
        whole = np.zeros((len(bits), self.count), np.int64)
        floats = bits.astype(np.float32)
        for size in [CODE] * self.codes + [self.raw] * (self.raw > 0):
            gather = np.zeros((BITS, self.count), np.float32)
            gather[self.orders[:, at : at + size].T, np.arange(self.count)] = weights[:size, None]
            values = (floats @ gather).astype(np.int64)
            whole = (whole << size) | (nearest_code_word(values) if size == CODE else values)
            at += size
        return self.key(np.broadcast_to(np.arange(self.count), whole.shape), whole)


def _unpacked(part: pa.RecordBatch, first: int) -> np.ndarray:
    words = np.stack([part.column(first + i).to_numpy() for i in range(WORDS)], axis=1)
    return np.unpackbits(words.astype("<i8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a whole text (null: a value of its own)."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


def add_sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _k1, _k2, node, s0..s3): text keys, hash of the words in lower case, sketch of the set of pairs of words."""
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, _k1 bigint, _k2 bigint, node bigint, " + ", ".join(f"s{i} bigint" for i in range(WORDS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            nodes, marks = np.zeros(part.num_rows, np.uint64), np.zeros((part.num_rows, WORDS), np.int64)
            for at, value in enumerate(part.column(3)):
                text = value.as_py() or ""
                nodes[at] = xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), SEED)
                marks[at] = sketch(np.unique(shingle_hashes(text, PAIR)))
            columns = [*part.columns[:3], pa.array(nodes.view(np.int64)), *(pa.array(marks[:, i]) for i in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_k1", "_k2", "node", *(f"s{i}" for i in range(WORDS))])

    return docs.select(F.col(id_col).alias("_id"), *text_keys(F.col(text_col)), F.col(text_col).alias("_text")).mapInArrow(work, schema)


def _first_rows(nodes: DataFrame, windows: Windows) -> DataFrame:
    """(anchor, node): every node at its anchor of every window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, 1024):
                piece = part.slice(at, 1024)
                keys = windows.first(_unpacked(piece, 1))
                again = np.repeat(np.arange(piece.num_rows), windows.count)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), piece.column(0).take(pa.array(again))], names=["anchor", "node"])

    return nodes.select("node", "s0", "s1", "s2", "s3").mapInArrow(work, "anchor bigint, node bigint")


def _differ(left: str, right: str) -> Column:
    return F.bit_count(F.col(left).bitwiseXOR(F.col(right)))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs u < v of two different nodes (node, v)."""
    return pairs.where("node <> v").select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()


def _representatives(rows: DataFrame, held: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(each node's densest representative, all pairs of nodes and representatives, rows that these don't cover).

    The nodes of a bucket of up to COMPLETE meet all others. For a larger one the smallest node stands, and the densest: the
    one whose own buckets hold most nodes, which for edited copies of one text is that text. They are found by partial
    aggregation and joins carry a row a node, so neither the time nor the rows of a bucket grow faster than its nodes.
    """
    buckets = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_a"), F.max("node").alias("_b")).where("_n > 1")
    # written, so that joins are between plain shuffles and the partition of a large bucket can be split
    buckets = held.write(buckets, "buckets")
    pairs = buckets.where("_n = 2").select(F.col("_a").alias("node"), F.col("_b").alias("v"))
    met = held.write(rows.hint("merge").join(buckets.where("_n > 2"), "anchor"), "met")
    crowded = met.where(F.col("_n") > COMPLETE).select("anchor", "node", "_n")
    density = crowded.groupBy("node").agg(F.sum("_n").alias("_d"))
    ranked = F.struct("_d", F.xxhash64("node").alias("h"), "node")
    dense = held.write(crowded.join(density, "node").groupBy("anchor").agg(F.max(ranked).alias("_c")), "dense")
    center = crowded.join(dense, "anchor").select("node", F.col("_c._d").alias("_d"), F.col("_c.node").alias("v"))
    first = center.where("node <> v").groupBy("node").agg(F.max(F.struct("_d", "v")).alias("_p")).select("node", F.col("_p.v").alias("v"))
    few = met.where(F.col("_n") <= COMPLETE).groupBy("anchor").agg(F.array_sort(F.collect_list("node")).alias("_m"))
    small = few.select("_m", F.posexplode("_m").alias("_i", "node")).select("node", F.explode(F.slice("_m", F.col("_i") + 2, F.size("_m"))).alias("v"))
    every = pairs.unionByName(small).unionByName(center.select("node", "v")).unionByName(met.where(F.col("_n") > COMPLETE).select("node", F.col("_a").alias("v")))
    return first, _ordered(every), crowded.select("anchor", "node")


def _prefixes(texts: DataFrame, roots: DataFrame, width: int, similarity: float, held: Scratch) -> DataFrame:
    """(shingle, node, size, at, indexed, root) of the rarest shingles of each text of `texts` (node, _text).

    Shingles are ordered by the number of these texts that hold them (then by hash), `at` is the place in that order. Of
    two texts whose similarity is reached, the longer one's first size - ceil(t size) + 1 shingles and the first
    size - ceil(2 t / (1 + t) size) + 1 of the shorter one (`indexed`) have one in common.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for node, text in zip(part.column(0), part.column(1)):
                found = np.unique(shingle_hashes(text.as_py(), width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node.as_py())), pa.array(found)], names=["node", "shingle"])

    rows = held.write(texts.select("node", "_text").mapInArrow(work, "node bigint, shingle bigint"), "shingles")
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    ordered = rows.join(shared, "shingle", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(1)).alias("_df"), "shingle"))).alias("_s"))
    size = F.size("_s")
    length = lambda share: (size - F.ceil(size * share - 1e-9) + 1).cast("int")
    probe, index = length(similarity), length(2 * similarity / (1 + similarity))
    cut = ordered.select("node", size.alias("size"), index.alias("_q"), F.slice("_s", F.lit(1), probe).alias("_p")).select("node", "size", "_q", F.posexplode("_p").alias("at", "_e"))
    cut = cut.where("_e._df > 1").select("_e.shingle", "node", "size", "at", (F.col("at") < F.col("_q")).alias("indexed"))
    return held.write(cut.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "prefixes")


def _prefix_pairs(prefixes: DataFrame, similarity: float, held: Scratch) -> DataFrame:
    """Distinct pairs (u, v) of nodes of different groups whose prefixes meet and whose sizes and places allow the similarity.

    A shingle whose nodes are all in one group is left out. Of the others, nodes of its most frequent group meet only
    nodes of other groups: what is compared follows the nodes of a bucket times those outside its largest group.
    """
    own = prefixes.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("_n"))
    mixed = own.groupBy("shingle").agg(F.max(F.struct("_n", "root")).alias("_m"), F.count(F.lit(1)).alias("_roots")).where("_roots > 1")
    rows = held.write(prefixes.join(mixed.select("shingle", F.col("_m.root").alias("_major")), "shingle").withColumn("minor", F.expr("root <> _major")), "mixed")
    left = rows.select("shingle", *(F.col(c).alias(c + "1") for c in ("node", "size", "at", "root", "minor")))
    right = rows.where("indexed").select("shingle", *(F.col(c).alias(c + "2") for c in ("node", "size", "at", "root", "minor")))
    fits = F.expr(
        f"root1 <> root2 and (size2 < size1 or size2 = size1 and node2 <> node1) and size2 >= {similarity} * size1 - 1e-9"
        f" and least(size1 - at1, size2 - at2) >= {similarity / (1 + similarity)} * (size1 + size2) - 1e-9"
    )
    one = left.where("minor1").join(right, "shingle").where(fits)
    two = left.where("not minor1").join(right.where("minor2"), "shingle").where(fits)
    both = one.select("node1", "node2").unionByName(two.select("node1", "node2"))
    return both.select(F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v")).distinct()


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _verify(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose texts' sets of shingles have a Jaccard similarity of at least `similarity`."""
    whole = pairs.select("u", "v")
    for side in ("v", "u"):
        whole = whole.join(texts.select(F.col("node").alias(side), F.col("_text").alias("_" + side)), side)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            same, last, known = [], None, np.empty(0, np.uint64)
            for u, a, b in zip(*(part.column(i) for i in (0, 2, 3))):
                if u.as_py() != last:
                    last, known = u.as_py(), np.unique(shingle_hashes(a.as_py(), width))
                same.append(_jaccard(known, np.unique(shingle_hashes(b.as_py(), width))) >= similarity)
            yield part.select([0, 1]).filter(pa.array(same, pa.bool_()))

    return whole.select("u", "v", "_u", "_v").mapInArrow(work, "u bigint, v bigint")


class _Groups:
    """Links found so far and the groups they make, over the nodes of one table."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, similarity: float, text_col: str):
        self.docs, self.nodes, self.width, self.similarity, self.text_col = docs, nodes, width, similarity, text_col
        spark = docs.sparkSession
        self.held = Scratch()
        self.links = self.tried = spark.createDataFrame([], "u bigint, v bigint")
        self.roots = spark.createDataFrame([], "node bigint, root bigint")

    def decide(self, pairs: DataFrame, roots: DataFrame, held: Scratch) -> DataFrame | None:
        """The links among those pairs that lie in different groups by `roots`, are near by their sketches and weren't decided yet."""
        pairs = pairs.join(self.tried, ["u", "v"], "left_anti")
        for side in ("u", "v"):
            pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias("_r" + side)), side, "left")
        pairs = pairs.where(F.coalesce("_ru", "u") != F.coalesce("_rv", "v")).select("u", "v")
        marks = [f"s{i}" for i in range(WORDS)]
        for side in ("u", "v"):
            pairs = pairs.join(self.nodes.select(F.col("node").alias(side), *(F.col(m).alias(side + m) for m in marks)), side)
        near = sum((_differ("u" + m, "v" + m) for m in marks), F.lit(0)) <= FAR
        pairs = self.held.write(pairs.where(near).select("u", "v"), "candidates")
        if pairs.isEmpty():
            return None
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        self.tried = self.tried.unionByName(pairs)
        new = self.held.write(_verify(pairs, self.texts(ends, held), self.width, self.similarity), "links")
        self.links = self.links.unionByName(new)
        return new

    def texts(self, wanted: DataFrame, held: Scratch) -> DataFrame:
        """(node, _text) of the wanted nodes: the text of any of the rows that hold it; rows of equal keys are equal."""
        wanted = wanted.join(self.nodes.select("node", "_rep"), "node").select("node", F.col("_rep._k1").alias("_k1"), F.col("_rep._k2").alias("_k2"))
        wanted = held.write(wanted, "wanted")
        texts = self.docs.select(*text_keys(F.col(self.text_col)), F.col(self.text_col).alias("_text"))
        texts = keep_possible(texts, wanted, "_k1").join(wanted, ["_k1", "_k2"])
        return held.write(texts.groupBy("node").agg(F.first("_text").alias("_text")), "texts")

    def decide_crowded(self, rows: DataFrame, held: Scratch) -> None:
        """Decide all pairs of different groups among the nodes of `rows` (anchor, node), exactly, by their rarest shingles."""
        left = held.write(self.mixed(rows, held).select("node").distinct(), "crowded")
        if left.isEmpty():
            return
        prefixes = _prefixes(self.texts(left, held), self.roots, self.width, self.similarity, held)
        if self.decide(_prefix_pairs(prefixes, self.similarity, held), self.roots, held) is not None:
            self.roots = connected_components(self.links)

    def decide_level(self, first: DataFrame, every: DataFrame, held: Scratch) -> None:
        """Decide a level's pairs: each node against its densest representative, then all that lie apart after that.

        In between, a node counts as one with the representative it was found near to, without a search for components.
        """
        first = held.write(first, "first")
        new = self.decide(_ordered(first), self.roots, held)
        joined = self.roots
        if new is not None:
            hubs = first.select("node", "v", F.least("node", "v").alias("u_"), F.greatest("node", "v").alias("v_"))
            hubs = hubs.join(new.select(F.col("u").alias("u_"), F.col("v").alias("v_")), ["u_", "v_"]).select("node", F.col("v").alias("hub"))
            named = hubs.join(self.roots.select(F.col("node").alias("hub"), "root"), "hub", "left").select("node", F.coalesce("root", "hub").alias("root"))
            joined = held.write(named.unionByName(self.roots.join(named, "node", "left_anti")), "joined")
        more = self.decide(every, joined, held)
        if new is not None or more is not None:
            self.roots = connected_components(self.links)

    def mixed(self, rows: DataFrame, held: Scratch) -> DataFrame:
        """The rows of buckets whose nodes aren't all in one group."""
        rooted = rows.join(self.roots, "node", "left").withColumn("_root", F.coalesce("root", "node"))
        split = rooted.groupBy("anchor").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")).where("_low <> _high")
        return rows.join(held.write(split.select("anchor"), "mixed"), "anchor")


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _k1, _k2, component_id, kept) of every document, a document being an id with a text (see `text_keys`).

    Documents whose words are equal but for the case of A-Z form a node and are never paired. Nodes are linked when the
    sets of `width`-word shingles of their texts have a Jaccard similarity of at least `similarity`; groups are the
    connected components, named by the smallest id in them. `kept` holds for one document of each group: the one of the
    smallest id (nulls last; among equal ids, by the text's keys).

    Search: windows of a node's 256-bit sketch are brought to the nearest words of a covering code, with a threshold of 0
    in each window (an anchor is the home alone; recall comes from the number of windows). The nodes of a bucket of up to
    COMPLETE all meet, those of a larger one meet its representatives, first the densest one, then all of other groups.
    Links are decided on whole texts. Nodes of larger buckets that are then in several groups are compared exactly, by an
    index of prefixes of their rarest shingles: of two of these nodes that are in different groups, no link is missed.
    Windows cost a row for each node and window, whatever the size of the groups.

    Texts without words (null, empty, white space) are one node. Rows that repeat an id and a text are one document.
    Other columns are not read; an empty table gives no rows.
    """
    base, held = Scratch(), Scratch()
    marked = base.write(add_sketches(docs, id_col, text_col), "sketches")
    least = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_k1", "_k2")
    marks = [F.first(f"s{i}").alias(f"s{i}") for i in range(WORDS)]
    nodes = base.write(marked.groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("_rep"), F.min(least).alias("_least"), *marks), "nodes")
    windows, found = Windows(nodes.count()), _Groups(docs, nodes, width, similarity, text_col)
    first, every, crowded = _representatives(_first_rows(nodes, windows), held)
    found.decide_level(first, every, held)
    found.decide_crowded(crowded, held)
    rooted = nodes.select("node", "_least").join(found.roots, "node", "left").select("node", "_least", F.coalesce("root", "node").alias("_root"))
    named = rooted.join(rooted.groupBy("_root").agg(F.min("_least").alias("_first")), "_root").select("node", "_first")
    met = marked.select("_id", "_k1", "_k2", "node").distinct().join(named, "node")
    kept = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_k1") == F.col("_first._k1")) & (F.col("_k2") == F.col("_first._k2"))
    groups = materialize(met.select("_id", "_k1", "_k2", F.col("_first._id").alias("component_id"), kept.alias("kept")), "groups")
    for used in (base, held, found.held):
        used.clear()
    return groups


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, without those of documents that aren't kept (`near_duplicate_groups`).

    Rows are matched by id (null is a value) and text, so rows that repeat both stay or go together.
    """
    gone = near_duplicate_groups(docs, width, similarity, id_col, text_col).where(~F.col("kept")).select("_id", "_k1", "_k2")
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_user"), docs[id_col].alias("_doc"), *text_keys(docs[text_col]))
    met = held.join(gone, held["_doc"].eqNullSafe(gone["_id"]) & (held["_k1"] == gone["_k1"]) & (held["_k2"] == gone["_k2"]), "left_anti")
    return met.select("_user.*")
