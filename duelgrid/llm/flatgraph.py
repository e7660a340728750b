"""A robust-pruned flat graph over one shard of unit vectors, and the search for all within range, in numpy."""

from __future__ import annotations

import numpy as np

#: Nearest members, and nearest of a random part of the members, among which a node's neighbours are chosen; how many of each.
NEAR, FAR, NEAR_KEPT, FAR_KEPT = 48, 16, 16, 8
#: Most neighbours of a node in one shard, and how much nearer a neighbour must be than the node to stand for another one.
DEGREE, ALPHA = 32, 1.2
#: Nodes that are handled at once, in building and in searching.
BLOCK = 256
#: Entry points of a search.
MEDOIDS = 16


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * similarity, 0))


def _nearest_first(units: np.ndarray, nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(`others` [node, place] by falling similarity, similarities); -1, which comes last, is no node."""
    near = np.einsum("bcd,bd->bc", units[others], units[nodes])
    near = np.where((others < 0) | (others == nodes[:, None]), -2.0, near)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(others, order, axis=1), np.take_along_axis(near, order, axis=1)


def robust_prune(units: np.ndarray, nodes: np.ndarray, others: np.ndarray, kept: int, chosen: np.ndarray | None = None) -> np.ndarray:
    """Up to `kept` of `others` [node, place] for each node, -1 for none: the nearest, without those that it stands for, and so on.

    One stands for another if ALPHA times the distance between them is at most the node's distance to that other. With
    `chosen`, others that these stand for are left out too.
    """
    others, near = _nearest_first(units, nodes, others)
    alive = near > -2
    far = _distance(near)
    vectors = units[others]

    def drop(picked: np.ndarray, of: np.ndarray) -> None:
        between = _distance(np.einsum("bcd,bd->bc", vectors, units[picked]))
        alive[(ALPHA * between <= far) & of[:, None]] = False

    for column in [] if chosen is None else chosen.T:
        drop(column, column >= 0)
    out = np.full((len(nodes), kept), -1, np.int64)
    rows = np.arange(len(nodes))
    for place in range(kept):
        first = alive.argmax(axis=1)
        there = alive[rows, first]
        if not there.any():
            break
        out[there, place] = others[rows, first][there]
        alive[rows, first] = False
        drop(others[rows, first], there)
    return out


def _lists(sources: np.ndarray, targets: np.ndarray, count: int, most: int) -> np.ndarray:
    """[source, place] targets, at most `most` of a source, -1 for none."""
    order = np.argsort(sources, kind="stable")
    sources, targets = sources[order], targets[order]
    place = np.arange(len(sources)) - np.searchsorted(sources, sources)
    out = np.full((count, min(most, int(place.max(initial=0)) + 1)), -1, np.int64)
    fits = place < most
    out[sources[fits], place[fits]] = targets[fits]
    return out


def build(units: np.ndarray, seed: int) -> np.ndarray:
    """[node, place] neighbours of every node (-1: none): near and far members, pruned, with the edges' reverses, pruned again."""
    count, random = len(units), np.random.default_rng(seed & (1 << 63) - 1)
    near, far = min(NEAR + 1, count), min(FAR, count)
    own = []
    for first in range(0, count, BLOCK):
        nodes = np.arange(first, min(first + BLOCK, count))
        alike = units[nodes] @ units.T
        closest = np.argpartition(-alike, near - 1, axis=1)[:, :near]
        some = random.choice(count, min(count, max(far, count // 8)), replace=False)
        farther = some[np.argpartition(-alike[:, some], far - 1, axis=1)[:, :far]]
        chosen = robust_prune(units, nodes, closest, NEAR_KEPT)
        own.append(np.hstack([chosen, robust_prune(units, nodes, farther, FAR_KEPT, chosen)]))
    graph = np.vstack(own)
    sources, place = np.nonzero(graph >= 0)
    targets = graph[sources, place]
    edges = np.unique(np.r_[sources * count + targets, targets * count + sources])
    sources, targets = np.divmod(edges, count)
    shuffled = random.permutation(len(edges))
    both = _lists(sources[shuffled], targets[shuffled], count, 4 * DEGREE)
    full = np.flatnonzero((both >= 0).sum(axis=1) > DEGREE)
    out = np.full((count, DEGREE), -1, np.int64)
    short = np.sort(both, axis=1)[:, ::-1][:, :DEGREE]
    out[:, : short.shape[1]] = short
    for first in range(0, len(full), BLOCK):
        nodes = full[first : first + BLOCK]
        out[nodes] = robust_prune(units, nodes, both[nodes], DEGREE)
    return out


def medoids(units: np.ndarray) -> np.ndarray:
    """The member nearest to the mean, then those farthest from all chosen ones."""
    chosen = [int((units @ units.mean(axis=0)).argmax())]
    nearest = units @ units[chosen[0]]
    while len(chosen) < min(MEDOIDS, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return np.array(chosen)


def _greedy(units: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) [query, place] of the nearest nodes that a best-first search of each query ends with."""
    count, rows = len(units), np.arange(len(queries))
    held = np.broadcast_to(entries, (len(queries), len(entries)))
    held, near = _nearest_first(units, queries, held.copy())
    # a query is a node itself, but is searched for like any other
    own = (held == queries[:, None]) & (near == -2)
    near[own] = 1
    order = np.argsort(-near, axis=1, kind="stable")[:, :beam]
    held, near = np.take_along_axis(held, order, axis=1), np.take_along_axis(near, order, axis=1)
    seen = np.zeros((len(queries), count), bool)
    seen[rows[:, None], held] = True
    spare = ((0, 0), (0, beam - held.shape[1]))
    held, near, done = np.pad(held, spare, constant_values=-1), np.pad(near, spare, constant_values=-3.0), np.zeros((len(queries), beam), bool)
    while True:
        todo = np.where(done, -3.0, near)
        first = todo.argmax(axis=1)
        active = np.flatnonzero(todo[rows, first] > -3)
        if not len(active):
            return held, near
        done[active, first[active]] = True
        next_ = graph[held[active, first[active]]]
        fresh = (next_ >= 0) & ~seen[active[:, None], next_]
        seen[np.broadcast_to(active[:, None], next_.shape)[fresh], next_[fresh]] = True
        found = np.where(fresh, np.einsum("bcd,bd->bc", units[next_], units[queries[active]]), -3.0)
        nodes, alike = np.hstack([held[active], next_]), np.hstack([near[active], found])
        flags = np.hstack([done[active], ~fresh])
        best = np.argsort(-alike, axis=1, kind="stable")[:, :beam]
        held[active], near[active], done[active] = (np.take_along_axis(x, best, axis=1) for x in (nodes, alike, flags))


def within_range(units: np.ndarray, graph: np.ndarray, reach: float, beam: int, widen: float = 1.2) -> np.ndarray:
    """(query, node) pairs that range-expanding searches of all nodes find: similarity `reach` or more, in both orders.

    A best-first search from the medoids gives each query its nearest nodes; one that it missed itself starts from itself
    too. From there, every node within `widen` times the range is expanded, until no new one turns up.
    """
    entries, count = medoids(units), len(units)
    wide = np.cos(min(np.pi, widen * np.arccos(reach)))
    pairs = []
    for first in range(0, count, BLOCK):
        queries = np.arange(first, min(first + BLOCK, count))
        held, near = _greedy(units, graph, entries, queries, beam)
        seen = np.zeros(len(queries) * count, bool)
        row, place = np.nonzero(near >= wide)
        frontier = np.unique(np.r_[row * count + held[row, place], np.arange(len(queries)) * count + queries])
        seen[frontier] = True
        found = [frontier]
        while len(frontier):
            row, node = np.divmod(frontier, count)
            step, parts = max(1, (1 << 21) // graph.shape[1]), []
            for at in range(0, len(row), step):
                next_ = graph[node[at : at + step]]
                keys = (row[at : at + step, None] * count + next_)[next_ >= 0]
                keys = np.unique(keys[~seen[keys]])
                seen[keys] = True
                parts.append(keys[_alike(units, queries, keys, count) >= wide])
            frontier = np.concatenate(parts)
            found.append(frontier)
        keys = np.concatenate(found)
        row, node = np.divmod(keys[_alike(units, queries, keys, count) >= reach - 1e-5], count)
        pairs.append(queries[row] * count + node)
    keys = np.concatenate(pairs)
    a, b = np.divmod(keys, count)
    keys = np.unique(np.r_[keys, b * count + a])
    return np.stack(np.divmod(keys, count), axis=1)


def _alike(units: np.ndarray, queries: np.ndarray, keys: np.ndarray, count: int) -> np.ndarray:
    out = np.empty(len(keys), units.dtype)
    step = max(1, (1 << 22) // units.shape[1])
    for at in range(0, len(keys), step):
        row, node = np.divmod(keys[at : at + step], count)
        out[at : at + step] = np.einsum("bd,bd->b", units[queries[row]], units[node])
    return out


def roots(count: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches over the pairs."""
    root = np.arange(count)
    while True:
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(root, pairs[:, 1], root[pairs[:, 0]])
        root = root[root]
        if (root == before).all():
            return root
