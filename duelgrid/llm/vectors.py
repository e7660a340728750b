"""Near-duplicate embeddings: flat graphs of overlapping cluster shards, searched from medoids, audited and verified."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm import flatgraph
from duelgrid.llm.bloom import mixed
from duelgrid.llm.components import connected_components
from duelgrid.llm.storage import Scratch, materialize

#: Most vectors of a shard, and nearest centres to which a vector goes when a shard is split.
SHARD, OVERLAP = 4096, 4
#: Most centres of a split, sampled rows for each centre (the bound of the sample that centres are fitted on), rounds of the fit.
CENTRES, FIT_ROWS, ROUNDS = 256, 64, 8
#: Rows of a large shard that are assigned to centres in one group, and splits after which shards are dealt by a hash.
DEALT, SPLITS = 16384, 8
#: Nodes that a search from the medoids keeps.
BEAM = 8
#: Vectors whose links are counted against all others, and the share of them that is to be found.
AUDITED, RECALL = 512, 0.98


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _centres(units: np.ndarray, wanted: int, seed: int) -> np.ndarray:
    """Centres of some rounds of k-means; one that loses its vectors is moved to the vector farthest from all."""
    random = np.random.default_rng(seed & (1 << 63) - 1)
    centres = units[random.choice(len(units), min(wanted, len(units)), replace=False)]
    for _ in range(ROUNDS):
        gap = (centres**2).sum(axis=1) - 2 * units @ centres.T
        own = gap.argmin(axis=1)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        centres = sums / np.maximum(sizes, 1)[:, None]
        lost = np.flatnonzero(sizes == 0)
        centres[lost] = units[np.argsort(-gap.min(axis=1))[: len(lost)]]
    return centres


def _split(rows: DataFrame, sizes: DataFrame, level: int, overlap: int) -> DataFrame:
    """The rows (node, mult, vec, shard) of shards of `sizes` (shard, size) in smaller shards: the nearest centres of each vector.

    Centres are fitted in a task on FIT_ROWS sampled rows for each; vectors meet them in groups of about DEALT rows.
    """
    wanted = F.least(F.lit(CENTRES), F.greatest(F.lit(2 * overlap), F.ceil(F.col("size") * 2 * overlap / SHARD))).cast("int")
    known = rows.join(sizes.withColumn("wanted", wanted), "shard")
    sample = known.where(F.pmod(F.xxhash64(F.lit(level), "node"), F.col("size")) < FIT_ROWS * F.col("wanted")).select("shard", "wanted", "vec")

    def fit(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        centres = _centres(_units(_matrix(table.column("vec"))), table.column("wanted")[0].as_py(), shard + level)
        return pa.table({"shard": pa.array([shard]), "centres": pa.array([centres.astype("<f8").tobytes()], pa.binary()), "dims": pa.array([centres.shape[1]], pa.int32())})

    fitted = sample.groupBy("shard").applyInArrow(fit, "shard bigint, centres binary, dims int").join(sizes, "shard")
    groups = F.expr(f"cast(ceil(size / {DEALT}) as int)")
    fitted = fitted.select("shard", "centres", "dims", F.explode(F.sequence(F.lit(0), groups - 1)).alias("group"))
    dealt = known.select("node", "mult", "vec", "shard", F.pmod(F.xxhash64("node"), groups).cast("int").alias("group"))

    def assign(rows: pa.Table, fit: pa.Table) -> pa.Table:
        if not rows.num_rows or not fit.num_rows:
            return rows.slice(0, 0).select(["node", "mult", "vec", "shard"])
        centres = np.frombuffer(fit.column("centres")[0].as_py(), "<f8").reshape(-1, fit.column("dims")[0].as_py())
        some = min(overlap, len(centres))
        gap = (centres**2).sum(axis=1) - 2 * _units(_matrix(rows.column("vec"))) @ centres.T
        nearest = np.argpartition(gap, some - 1, axis=1)[:, :some]
        parent = np.uint64(rows.column("shard")[0].as_py() & (1 << 64) - 1)
        names = mixed(nearest.astype(np.uint64) + mixed(np.array([parent + np.uint64(1)], np.uint64)))
        again = pa.array(np.repeat(np.arange(rows.num_rows), some))
        taken = rows.select(["node", "mult", "vec"]).take(again)
        return taken.append_column("shard", pa.array(names.ravel().view(np.int64)))

    return dealt.groupBy("shard", "group").cogroup(fitted.groupBy("shard", "group")).applyInArrow(assign, "node bigint, mult bigint, vec array<double>, shard bigint")


def _shards(classes: DataFrame, overlap: int, held: Scratch) -> DataFrame:
    """(node, mult, vec, shard) of overlapping shards of at most SHARD vectors; vectors of different lengths are never together."""
    rows, done, level = classes.select("node", "mult", "vec", F.size("vec").cast("long").alias("shard")), [], 0
    while True:
        sizes = held.write(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SHARD), "sizes")
        if sizes.isEmpty():
            break
        done.append(rows.join(sizes, "shard", "left_anti"))
        if level == SPLITS:
            rows = rows.join(sizes, "shard").withColumn("shard", F.xxhash64("shard", F.pmod(F.xxhash64("node"), F.expr(f"ceil(size * 2 / {SHARD})")))).drop("size")
            break
        rows = held.write(_split(rows, sizes, level, overlap), "split")
        level += 1
    for part in done:
        rows = rows.unionByName(part)
    return held.write(rows.select("node", "mult", "vec", "shard"), "shards")


def _graphs(shards: DataFrame) -> DataFrame:
    """(node, shard, near): each node's neighbours in the graph of each of its shards."""

    def work(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy())
        nodes, units = table.column("node").to_numpy()[order], _units(_matrix(table.column("vec")))[order].astype(np.float32)
        graph = flatgraph.build(units, table.column("shard")[0].as_py())
        there = graph >= 0
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(axis=1))], pa.int32()), pa.array(nodes[graph[there]]))
        return pa.table({"node": pa.array(nodes), "shard": pa.array(np.full(len(nodes), table.column("shard")[0].as_py(), np.int64)), "near": lists})

    return shards.groupBy("shard").applyInArrow(work, "node bigint, shard bigint, near array<bigint>")


def _searched(shards: DataFrame, lists: DataFrame, similarity: float, beam: int) -> DataFrame:
    """(node, links, root) by shard: linked vectors of each node, and a node of the same group.

    A pair of vectors that share several shards is counted in the first of these.
    """

    def work(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("node").to_numpy())))
        nodes, shard, mult = table.column("node").to_numpy(), table.column("shard")[0].as_py(), table.column("mult").to_numpy()
        matrix = _matrix(table.column("vec"))
        units, count = _units(matrix), len(nodes)
        near = table.column("near").combine_chunks()
        source, target = np.repeat(np.arange(count), np.diff(near.offsets.to_numpy())), near.flatten().to_numpy()
        place = np.minimum(np.searchsorted(nodes, target), count - 1)
        inside = nodes[place] == target
        graph = flatgraph._lists(source[inside], place[inside], count, 1 << 30)
        pairs = flatgraph.within_range(units.astype(np.float32), graph, similarity, beam)
        pairs, kept = pairs[pairs[:, 0] < pairs[:, 1]], []
        homes = flatgraph._lists(*_flat(table.column("homes")), count, 1 << 30)
        step = max(1, (1 << 20) // max(matrix.shape[1], homes.shape[1] ** 2))
        links = np.zeros(count, np.int64)
        for at in range(0, len(pairs), step):
            a, b = pairs[at : at + step].T
            a, b = (x[np.einsum("ij,ij->i", units[a], units[b]) >= similarity] for x in (a, b))
            kept.append(np.stack([a, b], axis=1))
            left, right = homes[a][:, :, None], homes[b][:, None, :]
            first = ~((left == right) & (left != -1) & (left < shard)).any(axis=(1, 2))
            np.add.at(links, a[first], mult[b[first]])
            np.add.at(links, b[first], mult[a[first]])
        root = flatgraph.roots(count, np.concatenate(kept)) if kept else np.arange(count)
        some = (links > 0) | (root != np.arange(count))
        return pa.table({"node": pa.array(nodes[some]), "links": pa.array(links[some]), "root": pa.array(nodes[root[some]])})

    return shards.join(lists, "node").groupBy("shard").applyInArrow(work, "node bigint, links bigint, root bigint")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()


def count_links(classes: DataFrame, queries: DataFrame, similarity: float) -> DataFrame:
    """(node, true_links) of the `queries` (node, vec; a bounded number) by brute force against all of `classes`, in blocks."""
    asked = queries.select("node", "vec").collect()
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in {len(r["vec"]) for r in asked}:
        some = [r for r in asked if len(r["vec"]) == length]
        by_length[length] = np.array([r["node"] for r in some]), _units(np.array([r["vec"] for r in some]))
    shared = classes.sparkSession.sparkContext.broadcast(by_length)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lengths = np.diff(part.column(2).offsets.to_numpy())
            for length, (names, units) in shared.value.items():
                some = np.flatnonzero(lengths == length)
                for at in range(0, len(some), 1024):
                    rows = part.take(pa.array(some[at : at + 1024]))
                    alike = _units(_matrix(rows.column(2))) @ units.T >= similarity
                    alike &= rows.column(0).to_numpy()[:, None] != names
                    counts = rows.column(1).to_numpy() @ alike
                    yield pa.RecordBatch.from_arrays([pa.array(names[counts > 0]), pa.array(counts[counts > 0].astype(np.int64))], names=["node", "true_links"])

    found = classes.select("node", "mult", "vec").mapInArrow(work, "node bigint, true_links bigint")
    return found.groupBy("node").agg(F.sum("true_links").alias("true_links"))


def audit(classes: DataFrame, links: DataFrame, similarity: float, queries: int = AUDITED) -> float:
    """The share of the links of `queries` vectors, chosen by a hash, that `links` (node, links) has; 1 where they have none."""
    chosen = classes.orderBy(F.xxhash64(F.lit(5), "node")).limit(queries)
    truth = count_links(classes, chosen, similarity).join(links, "node", "left")
    row = truth.agg(F.sum("true_links").alias("t"), F.sum(F.least("true_links", F.coalesce("links", F.lit(0)))).alias("f")).first()
    return row["f"] / row["t"] if row["t"] else 1.0


def near_duplicate_vectors(vectors: DataFrame, similarity: float = 0.95, overlap: int = OVERLAP, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: rows with a cosine of at least `similarity`, and the groups they make.

    n_links counts other rows linked directly, component_id is the smallest id reachable by links (itself included),
    kept says whether that is the row's own. Cosines are computed in double precision and decide every link.

    Rows of one vector are a class, which is searched for once and never paired with itself. Classes are dealt to
    clusters, each to the `overlap` nearest ones, and clusters are split again until none has over SHARD vectors. A task
    builds the robust-pruned graph of a shard, lists of a vector in several shards are united, and a task searches a
    shard's graph from its medoids for each of its vectors, expanding all within range. It hands on a number of links and
    one node of the group for each vector, never pairs. Centres are fitted on samples (FIT_ROWS a centre), all else is
    done with all rows. An audit counts the links of AUDITED vectors by brute force; while less than RECALL of them was
    found, overlap and beam are doubled, twice at most; then a warning tells the figure.

    Links between vectors that share no shard are missed; in a group of more than SHARD different vectors that are all
    near one another, n_links counts those that share one. Vectors that are null, empty, zero, or hold null, NaN or
    infinite components link with nothing, and vectors of different lengths never link. A null id never names a group
    unless all its ids are null. Repeated rows are each returned, and are linked; other columns are not read; an empty
    table gives no rows.
    """
    held = Scratch()
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    usable = _usable(F.col("vec"))
    marked = held.write(rows.select("_id", usable.alias("_ok"), F.xxhash64("vec").alias("_k1"), F.xxhash64(F.lit(1), "vec").alias("_k2"), F.when(usable, F.col("vec")).alias("vec")), "vectors")
    classes = marked.where("_ok").groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("mult"), F.min("_id").alias("_least"), F.first("vec").alias("vec"))
    classes = held.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    for attempt in range(3):
        inner = Scratch()
        shards = _shards(classes, overlap, inner)
        graphs = inner.write(_graphs(shards), "graphs")
        lists = graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.sort_array(F.collect_list("shard")).alias("homes"))
        found = held.write(_searched(shards, lists, similarity, beam), "found")
        links = held.write(found.groupBy("node").agg(F.sum("links").alias("links")), "links")
        recall = audit(classes, links, similarity)
        inner.clear()
        if recall >= RECALL:
            break
        overlap, beam = 2 * overlap, 2 * beam
    else:
        warnings.warn(f"Of the audited links, {recall:.3f} were found", stacklevel=2)
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = classes.select("_k1", "_k2", "mult", "node", "_least").join(links, "node", "left").join(roots, "node", "left").withColumn("_root", F.coalesce("root", "node"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = held.write(named.join(least, "_root").select("_k1", "_k2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"), "named")
    plain = marked.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    judged = marked.where("_ok").select("_id", "_k1", "_k2").join(named, ["_k1", "_k2"]).select("_id", "n_links", "component_id").unionByName(plain)
    out = materialize(judged.select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")), "vectors")
    held.clear()
    return out
