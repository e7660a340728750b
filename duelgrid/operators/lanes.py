"""Many penalised fits on the same rows at once: penalties, left-out folds, weeks and replicates are lanes of one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.operators.contests import classes_of, model_sample, tasks_for
from duelgrid.operators.design import matchup_design

#: Numbers that the lanes of one job have at most (sums of a task, and what each lane counts of each group).
TASK_NUMBERS = 2_000_000
#: Numbers that a task works on at once: entries of rows x lanes x heads.
BLOCK_NUMBERS = 2_000_000
#: Numbers of a piece of the tasks' sums, which are added up piece by piece before the driver gets them.
PIECE = 4096
#: Terms up to which the curvature between terms (terms x terms numbers of a task and of the driver) is used for the steps.
CURVED_TERMS = 1500


@dataclass
class Packed:
    """Distinct weighted design rows of a model: (fold, weight, label, at, value), and the terms that `at` counts.

    With `groups`, the column `fold` is the place in it of the row's group (a game).
    """

    rows: DataFrame
    terms: list[str]
    model: str
    groups: list[str] = field(default_factory=list)


def pack(contests: DataFrame, model: str, weight: Column | None = None, roles: tuple[str, ...] = ("rusher", "blocker"), by: str = "fold", groups: list[str] | None = None) -> Packed:
    """Contests with the same players, help, class and fold are one weighted row; without `fold` all are in fold 0.

    With `groups`, rows are told apart by the column `by`, and `fold` is its place among them; rows of other groups are left out.
    """
    rows = model_sample(contests, model)
    cls = F.col("win_target").cast("int").cast("string") if model == "win" else F.col("severity_outcome")
    fold = F.col(by) if by in rows.columns else F.lit(0)
    if groups is not None:
        places = contests.sparkSession.createDataFrame([(g, i) for i, g in enumerate(groups)], f"{by} string, _place int")
        rows = rows.join(places, by)
        fold = F.col("_place")
    keys = ["_fold", "_cls", "rusher_key", "blocker_keys", "double_team", "double_team_unknown"]
    rows = rows.withColumns({"_fold": fold, "_cls": cls, "blocker_keys": F.array_sort("blocker_keys")})
    grouped = rows.repartition(tasks_for(contests), *keys).groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("weight")).where("weight > 0")
    grouped = grouped.withColumn("row_id", F.xxhash64(*keys))
    design = matchup_design(grouped, ["row_id"], roles)
    terms = [r["term"] for r in design.select("term").distinct().orderBy("term").collect()]
    names = contests.sparkSession.createDataFrame(list(zip(terms, range(len(terms)))), "term string, at int")
    entries = design.join(names, "term").groupBy("row_id").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))
    label = F.array_position(F.array(*(F.lit(c) for c in classes_of(model))), F.col("_cls")).cast("int") - 1
    packed = grouped.join(entries, "row_id").select(F.col("_fold").cast("int").alias("fold"), "weight", label.alias("label"), "at", "value")
    # few bytes, but much work a row: dealt over all cores, where a size in bytes would put them into one task
    packed = packed.repartition(contests.sparkSession.sparkContext.defaultParallelism)
    return Packed(packed, terms, model, groups or [])


class Block:
    """Some sparse rows: the entries of a row stand together, and an order of the entries puts those of a term together."""

    def __init__(self, part: pa.RecordBatch):
        column = {n: part.column(part.schema.get_field_index(n)) for n in ("fold", "weight", "label", "at", "value")}
        self.labels, self.folds = column["label"].to_numpy(), column["fold"].to_numpy()
        self.weights = column["weight"].to_numpy().astype(float)
        sizes = np.diff(column["at"].offsets.to_numpy())
        self.first = np.r_[0, np.cumsum(sizes)[:-1]]
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.at, self.value = column["at"].flatten().to_numpy(), column["value"].flatten().to_numpy()
        self.order = np.argsort(self.at, kind="stable")
        held = self.at[self.order]
        self.starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.empty(0, int)
        self.terms = held[self.starts]

    def times(self, table: np.ndarray) -> np.ndarray:
        """[row, column]: the rows times a table [term, column]."""
        out = np.zeros((len(self.labels), table.shape[1]))
        there = np.diff(np.r_[self.first, len(self.at)]) > 0
        if there.any():
            out[there] = np.add.reduceat(table[self.at] * self.value[:, None], self.first[there], axis=0)
        return out

    def turned(self, slopes: np.ndarray) -> np.ndarray:
        """[term of `terms`, column]: the terms' entries times slopes [row, column]."""
        if not len(self.at):
            return np.zeros((0, slopes.shape[1]))
        return np.add.reduceat((slopes[self.owner] * self.value[:, None])[self.order], self.starts, axis=0)


def blocks(parts: Iterator[pa.RecordBatch], columns: int) -> Iterator[Block]:
    """The rows of Arrow batches in blocks of about BLOCK_NUMBERS / columns entries."""
    for part in parts:
        entries = len(part.column(part.schema.get_field_index("at")).flatten())
        step = max(64, int(BLOCK_NUMBERS / max(columns, 1) / max(entries / max(part.num_rows, 1), 1)))
        for low in range(0, part.num_rows, step):
            yield Block(part.slice(low, step))


def linear(block: Block, theta: np.ndarray, heads: int) -> np.ndarray:
    """[lane, row, head] linear predictors of lanes whose parameters are `heads` times (coefficients, intercept)."""
    lanes = len(theta)
    table = theta.reshape(lanes * heads, -1)
    eta = block.times(np.ascontiguousarray(table[:, :-1].T)) + table[:, -1]
    return eta.reshape(-1, lanes, heads).transpose(1, 0, 2)


def logistic_parts(block: Block, theta: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """([lane, row] losses, [lane, row, head] slopes in the linear predictors) of binary (one head) and multinomial models."""
    eta, labels = linear(block, theta, heads), block.labels
    if heads == 1:
        one = eta[:, :, 0]
        power = np.exp(-np.abs(one))
        loss = np.maximum(one, 0.0) + np.log1p(power) - labels * one
        return loss, (np.where(one >= 0, 1.0, power) / (1 + power) - labels)[:, :, None]
    top = eta.max(axis=2, keepdims=True)
    powers = np.exp(eta - top)
    total = powers.sum(axis=2, keepdims=True)
    own = np.take_along_axis(eta, np.broadcast_to(labels[None, :, None], (*eta.shape[:2], 1)), axis=2)[:, :, 0]
    slope = powers / total
    slope[:, np.arange(len(labels)), labels] -= 1
    return (top + np.log(total))[:, :, 0] - own, slope


def ordinal_cuts(theta: np.ndarray, size: int) -> np.ndarray:
    """[lane, cut]: the first cut and exponentials of gaps, so that cuts stay ordered."""
    gaps = np.exp(theta[:, size + 1 :])
    return theta[:, size, None] + np.concatenate([np.zeros((len(theta), 1)), np.cumsum(gaps, axis=1)], axis=1)


def ordinal_parts(block: Block, theta: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """([lane, row] losses, [lane, row] slopes in the linear predictor, [lane, row, cut] slopes in the cuts)."""
    cuts, labels = ordinal_cuts(theta, size), block.labels
    eta = block.times(np.ascontiguousarray(theta[:, :size].T)).T
    edge = np.concatenate([np.full((*eta.shape, 1), -np.inf), cuts[:, None, :] - eta[:, :, None], np.full((*eta.shape, 1), np.inf)], axis=2)
    below = 1 / (1 + np.exp(-np.clip(edge, -700, 700)))
    below[:, :, 0], below[:, :, -1] = 0.0, 1.0
    slope = below * (1 - below)
    at = np.broadcast_to(labels[None, :, None], (*eta.shape, 1))
    pick = lambda a, k: np.take_along_axis(a, at + k, axis=2)[:, :, 0]
    chance = np.maximum(pick(below, 1) - pick(below, 0), 1e-300)
    high, low = pick(slope, 1) / chance, pick(slope, 0) / chance
    to_cuts = np.zeros((*eta.shape, cuts.shape[1]))
    for k in range(cuts.shape[1]):
        to_cuts[:, :, k] = np.where(labels == k, -high, np.where(labels == k + 1, low, 0.0))
    return -np.log(chance), high - low, to_cuts


def head_count(kind: str) -> int:
    return 4 if kind == "severity" else 1


def parameter_count(kind: str, size: int) -> int:
    return size + 3 if kind == "ordinal" else head_count(kind) * (size + 1)


def used_by(folds: np.ndarray, left_out: np.ndarray, upto: bool) -> np.ndarray:
    """[lane, row]: how often a lane counts a row.

    `left_out` is a fold for each lane, whose rows it leaves out, or, with `upto`, above which it does. Or it is a table
    [lane, fold] of the multiplicities of each fold (each game) in each lane.
    """
    if left_out.ndim == 2:
        return left_out[:, folds]
    return folds[None, :] <= left_out[:, None] if upto else folds[None, :] != left_out[:, None]


def _sums(kind: str, size: int, theta: np.ndarray, left_out: np.ndarray, upto: bool) -> Callable:
    """Sums over a task's rows for every lane: weight, loss and gradient."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes, heads = len(theta), 1 if kind == "ordinal" else head_count(kind)
        total = np.zeros((lanes, 2 + theta.shape[1]))
        slopes = np.zeros((lanes, heads, size + 1))
        for block in blocks(parts, lanes * heads):
            use = block.weights[None, :] * used_by(block.folds, left_out, upto)
            total[:, 0] += use.sum(axis=1)
            if kind == "ordinal":
                loss, to_eta, to_cuts = ordinal_parts(block, theta, size)
                slopes[:, 0, block.terms] += block.turned((use * to_eta).T).T
                of_cuts = (use[:, :, None] * to_cuts).sum(axis=1)
                gaps = np.exp(theta[:, size + 1 :])
                total[:, 2 + size] += of_cuts.sum(axis=1)
                for k in range(gaps.shape[1]):
                    total[:, 3 + size + k] += of_cuts[:, k + 1 :].sum(axis=1) * gaps[:, k]
            else:
                loss, slope = logistic_parts(block, theta, heads)
                slope = slope * use[:, :, None]
                turned = block.turned(slope.transpose(1, 0, 2).reshape(len(block.labels), -1))
                slopes[:, :, block.terms] += turned.T.reshape(lanes, heads, -1)
                slopes[:, :, size] += slope.sum(axis=1)
            total[:, 1] += (use * loss).sum(axis=1)
        if kind == "ordinal":
            total[:, 2 : 2 + size] = slopes[:, 0, :size]
        else:
            total[:, 2:] = slopes.reshape(lanes, -1)
        yield from pieces(total)

    return work


def pieces(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(piece, sums) of the numbers of a task's table."""
    flat = total.ravel()
    lists = [flat[at : at + PIECE] for at in range(0, len(flat), PIECE)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(lists)), pa.int32()), pa.array(lists, pa.list_(pa.float64()))], names=["piece", "sums"])


def added(rows: DataFrame, work: Callable, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over the tasks of the tables that `work` gives in pieces: pieces are added up in Spark, the driver gets each once."""

    def add(part: pa.Table) -> pa.Table:
        sums = np.stack([s.values.to_numpy() for s in part.column("sums").combine_chunks()]).sum(axis=0)
        return pa.table({"piece": part.column("piece").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    flat = np.zeros(int(np.prod(shape)))
    schema = "piece int, sums array<double>"
    for row in rows.mapInArrow(work, schema).groupBy("piece").applyInArrow(add, schema).toLocalIterator():
        flat[row["piece"] * PIECE : row["piece"] * PIECE + len(row["sums"])] = row["sums"]
    return flat.reshape(shape)


def evaluate(packed: DataFrame, kind: str, size: int, theta: np.ndarray, left_out: np.ndarray, penalties: np.ndarray, upto: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(losses, gradients) of the lanes: mean loss of the rows that the lane uses plus penalty / 2 x squared coefficients."""
    count = parameter_count(kind, size)
    step = max(1, TASK_NUMBERS // (count + 2 + (left_out.shape[1] if left_out.ndim == 2 else 0)))
    losses, slopes = np.zeros(len(theta)), np.zeros_like(theta)
    for low in range(0, len(theta), step):
        part = slice(low, low + step)
        sums = added(packed, _sums(kind, size, theta[part], left_out[part], upto), (len(theta[part]), 2 + count))
        held = np.maximum(sums[:, 0], 1e-300)
        losses[part], slopes[part] = sums[:, 1] / held, sums[:, 2:] / held[:, None]
    shape = penalised(kind, size)
    losses += penalties / 2 * (theta**2 * shape).sum(axis=1)
    return losses, slopes + penalties[:, None] * theta * shape


def penalised(kind: str, size: int) -> np.ndarray:
    """1 for coefficients, 0 for intercepts, cuts and gaps."""
    if kind == "ordinal":
        return np.concatenate([np.ones(size), np.zeros(3)])
    return np.tile(np.append(np.ones(size), 0.0), head_count(kind))


def scales(packed: DataFrame, kind: str, size: int, penalties: np.ndarray) -> np.ndarray:
    """[lane, parameter]: steps that bring the curvatures of all parameters to the same order."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for block in blocks(parts, 1):
            total[:size] += np.bincount(block.at, block.weights[block.owner] * block.value**2, minlength=size)
            total[size] += block.weights.sum()
        yield from pieces(total)

    total = added(packed, work, (size + 1,))
    curve = total[:size] / max(total[size], 1e-300) / 4
    if kind == "ordinal":
        every = np.concatenate([curve, np.full(3, 0.25)])
    else:
        every = np.tile(np.append(curve, 0.25), head_count(kind))
    return 1 / np.sqrt(every[None, :] + penalties[:, None] * penalised(kind, size)[None, :] + 1e-12)


class Curvature:
    """Products with the inverse of the lanes' curvature where no term has an effect yet, for steps of about the right length and direction.

    There every row has the chances of its class alone, so that the curvature is that of the rows' sums of squares and products
    times the spread of the classes, plus the penalty: one table of terms x terms for all lanes, from one pass over the rows.
    """

    def __init__(self, packed: DataFrame, kind: str, size: int, penalties: np.ndarray):
        labels = head_count(kind) if kind == "severity" else 2
        count = size + 1

        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((count * count) + labels)
            square = total[: count * count].reshape(count, count)
            # a block's dense rows are about as many numbers as other blocks hold
            for block in blocks(parts, max(16, count // 4)):
                rows = np.zeros((len(block.labels), count))
                np.add.at(rows, (block.owner, block.at), block.value)
                rows[:, size] = 1
                square += (rows * block.weights[:, None]).T @ rows
                total[count * count :] += np.bincount(block.labels, block.weights, minlength=labels)
            yield from pieces(total)

        total = added(packed, work, (count * count + labels,))
        square, self.kind = total[: count * count].reshape(count, count), kind
        held = max(square[size, size], 1e-300)
        # chances of 0 would leave a class without curvature
        chance = np.maximum(total[count * count :] / held, 1e-4)
        chance /= chance.sum()
        if kind == "severity":
            spread, self.turn = np.linalg.eigh(np.diag(chance) - np.outer(chance, chance))
        else:
            spread, self.turn = np.array([chance[0] * chance[1]]), np.ones((1, 1))
        # the intercept has no penalty: it is taken out of the terms, which are then on their own
        mean = square[size, :size] / held
        values, vectors = np.linalg.eigh((square[:size, :size] + square[:size, :size].T) / 2 / held - np.outer(mean, mean))
        self.values, self.vectors, self.mean = np.maximum(values, 0), vectors, mean
        self.spread, self.penalties = np.maximum(spread, 1e-6), penalties

    def solve(self, slope: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """[lane, parameter]: the inverse curvature of `lanes` times `slope`."""
        table = slope.reshape(len(slope), len(self.spread), -1)
        table = np.einsum("lhp,hk->lkp", table, self.turn)
        terms = table[:, :, :-1] - table[:, :, -1:] * self.mean
        curve = self.spread[None, :, None] * self.values + self.penalties[lanes][:, None, None] + 1e-12
        found = ((terms @ self.vectors) / curve) @ self.vectors.T
        constant = table[:, :, -1] / self.spread - found @ self.mean
        return np.einsum("lkp,hk->lhp", np.concatenate([found, constant[:, :, None]], axis=2), self.turn).reshape(slope.shape)


def minimise(packed: DataFrame, kind: str, size: int, penalties: np.ndarray, left_out: np.ndarray, start: np.ndarray | None = None, tolerance: float = 1e-6, rounds: int = 400, memory: int = 10, upto: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, losses, largest gradients, rounds used) of every lane, by L-BFGS steps taken side by side.

    Steps of the logistic models start from the curvature between all terms (`Curvature`), where these aren't too many.

    A round is one aggregation over the rows for all lanes that aren't finished; steps that don't lower a lane's loss
    enough are halved for that lane alone. Data stay in Spark: the driver holds parameters (lanes x terms). A lane leaves
    out the rows of its fold in `left_out` or, with `upto`, those of later folds (weeks).
    """
    lanes = len(penalties)
    theta = np.zeros((lanes, parameter_count(kind, size))) if start is None else start.copy()
    curved = Curvature(packed, kind, size, penalties) if kind != "ordinal" and 0 < size <= CURVED_TERMS else None
    scale = scales(packed, kind, size, penalties) if curved is None else np.ones((1, theta.shape[1])).repeat(lanes, axis=0)
    loss, slope = evaluate(packed, kind, size, theta, left_out, penalties, upto)
    slope *= scale
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    used, done = np.zeros(lanes, int), np.abs(slope / scale).max(axis=1) < tolerance
    for _ in range(rounds):
        if done.all():
            break
        live = np.flatnonzero(~done)
        way, kept = slope[live].copy(), []
        for s, y in reversed(steps):
            dot = (s[live] * y[live]).sum(axis=1)
            a = np.where(dot > 0, (s[live] * way).sum(axis=1) / np.where(dot > 0, dot, 1), 0.0)
            way -= a[:, None] * y[live]
            kept.append(a)
        if curved is not None:
            way = curved.solve(way, live)
        elif steps:
            s, y = steps[-1][0][live], steps[-1][1][live]
            dot, norm = (s * y).sum(axis=1), (y * y).sum(axis=1)
            way *= np.where((dot > 0) & (norm > 0), dot / np.where(norm > 0, norm, 1), 1.0)[:, None]
        for (s, y), a in zip(steps, reversed(kept)):
            dot = (s[live] * y[live]).sum(axis=1)
            b = np.where(dot > 0, (y[live] * way).sum(axis=1) / np.where(dot > 0, dot, 1), 0.0)
            way += s[live] * (a - b)[:, None]
        fall = (slope[live] * way).sum(axis=1)
        way[fall <= 0], fall = slope[live][fall <= 0], np.where(fall <= 0, (slope[live] ** 2).sum(axis=1), fall)
        length = np.ones(len(live)) if steps or curved is not None else np.minimum(1.0, 1 / np.maximum(np.abs(slope[live]).sum(axis=1), 1e-300))
        fresh, new_loss, new_slope = theta.copy(), loss.copy(), slope.copy()
        open_ = np.arange(len(live))
        while len(open_):
            which = live[open_]
            fresh[which] = theta[which] - length[open_, None] * way[open_] * scale[which]
            found, ahead = evaluate(packed, kind, size, fresh[which], left_out[which], penalties[which], upto)
            new_loss[which], new_slope[which] = found, ahead * scale[which]
            good = (found <= loss[which] - 1e-4 * length[open_] * fall[open_] + 1e-15) | (length[open_] < 1e-8)
            length[open_[~good]] /= 2
            open_ = open_[~good]
        moved, bent = (fresh - theta) / scale, new_slope - slope
        bends = (moved * bent).sum(axis=1) > 1e-300
        steps = [*steps, (np.where(bends[:, None], moved, 0.0), np.where(bends[:, None], bent, 0.0))][-memory:]
        stuck = np.zeros(lanes, bool)
        stuck[live] = (np.abs(new_loss[live] - loss[live]) <= 1e-15 * np.abs(loss[live])) & (length < 1e-7)
        theta, loss, slope = fresh, new_loss, new_slope
        used[live] += 1
        done = (np.abs(slope / scale).max(axis=1) < tolerance) | stuck
    return theta, loss, np.abs(slope / scale).max(axis=1), used


def held_out_losses(packed: DataFrame, kind: str, size: int, theta: np.ndarray, folds: np.ndarray, clips: tuple[float, ...]) -> np.ndarray:
    """[lane, 1 + clips]: weight of the lane's own fold, and its mean loss under each clip of the probabilities.

    `folds` is the fold of each lane, or a table [lane, fold] of the multiplicities with which a lane counts each.
    """

    def work(parts: Iterator[pa.RecordBatch], some: slice) -> Iterator[pa.RecordBatch]:
        held, own = theta[some], folds[some]
        total = np.zeros((len(held), 1 + len(clips)))
        for block in blocks(parts, len(held) * head_count(kind)):
            use = block.weights[None, :] * (own[:, block.folds] if own.ndim == 2 else block.folds[None, :] == own[:, None])
            loss = ordinal_parts(block, held, size)[0] if kind == "ordinal" else logistic_parts(block, held, head_count(kind))[0]
            total[:, 0] += use.sum(axis=1)
            for i, clip in enumerate(clips):
                total[:, 1 + i] += (use * -np.log(np.clip(np.exp(-loss), clip, 1.0 if kind != "win" else 1 - clip))).sum(axis=1)
        yield from pieces(total)

    step, out = max(1, TASK_NUMBERS // (theta.shape[1] + (folds.shape[1] if folds.ndim == 2 else 0))), []
    for low in range(0, len(theta), step):
        some = slice(low, low + step)
        out.append(added(packed, lambda parts, some=some: work(parts, some), (len(theta[some]), 1 + len(clips))))
    total = np.concatenate(out)
    total[:, 1:] /= np.maximum(total[:, :1], 1e-300)
    return total
