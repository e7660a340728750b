"""Bootstrap replicates as lanes: each counts the games as often as it drew them, and all are fitted side by side."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.operators import lanes as L
from duelgrid.operators.contests import classes_of, observations, participations
from duelgrid.operators.ridge import CLIPS, FINISHED, LANE_TOLERANCE, best_penalty, centred_tables
from duelgrid.operators.scoring import lane_outcomes, lane_score_types
from duelgrid.params import ROLES

#: Numbers of parameters, slopes and steps of the lanes that are fitted together, which the driver holds (400 MB).
HELD_NUMBERS, STEPS = 50_000_000, 24


@dataclass
class Games:
    """The games of the contests in order, their weeks and folds (0 for none), and each replicate's copies of them."""

    names: list[str]
    weeks: np.ndarray
    folds: np.ndarray
    copies: dict[int, np.ndarray]

    def present(self, contests: DataFrame) -> DataFrame:
        """(replicate_id, model, role, player_key, present_in_draw) of the players with a row in each replicate's games."""
        spark = contests.sparkSession
        drawn = spark.createDataFrame([(i, g) for i, own in self.copies.items() for g, n in zip(self.names, own) if n > 0], "replicate_id int, game_id string")
        seen = participations(observations(contests)).select("model", "role", "player_key", "game_id").distinct()
        return seen.join(drawn, "game_id").select("replicate_id", "model", "role", "player_key").distinct().withColumn("present_in_draw", F.lit(True))

    def packed(self, contests: DataFrame, model: str) -> L.Packed:
        """A model's rows, told apart by game."""
        found = L.pack(contests, model, by="game_id", groups=self.names)
        return L.Packed(found.rows.cache(), found.terms, model, self.names)


def games_of(contests: DataFrame, drawn: DataFrame, ids: list[int], folds: DataFrame | None = None) -> Games:
    """The games with contests, and their copies in the replicates `ids` of `drawn` (replicate_id, game_id, copies): replicates x games numbers."""
    rows = contests.groupBy("game_id").agg(F.min("week").alias("week"))
    rows = rows.join(folds.select("game_id", "fold"), "game_id", "left") if folds is not None else rows.withColumn("fold", F.lit(0))
    held = rows.orderBy("game_id").collect()
    if folds is not None and any(r["fold"] is None for r in held):
        raise ValueError("A game has no fold")
    names = [r["game_id"] for r in held]
    place = {n: i for i, n in enumerate(names)}
    copies = {i: np.zeros(len(names)) for i in ids}
    for r in drawn.where(F.col("replicate_id").isin(ids)).join(rows.select("game_id"), "game_id").toLocalIterator():
        copies[r["replicate_id"]][place[r["game_id"]]] += r["copies"]
    return Games(names, np.array([r["week"] for r in held]), np.array([r["fold"] for r in held]), copies)


def class_counts(packed: L.Packed) -> np.ndarray:
    """[class, game]: rows of each class by game."""
    out = np.zeros((len(classes_of(packed.model)), len(packed.groups)))
    for r in packed.rows.groupBy("label", "fold").agg(F.sum("weight").alias("n")).collect():
        out[r["label"], r["fold"]] = r["n"]
    return out


def some_lanes(count: int, kind: str, size: int) -> Iterator[slice]:
    """Slices of the lanes that can be fitted together."""
    step = max(1, HELD_NUMBERS // (STEPS * L.parameter_count(kind, size)))
    for low in range(0, count, step):
        yield slice(low, min(count, low + step))


def fit_lanes(packed: L.Packed, penalties: np.ndarray, copies: np.ndarray, tolerance: float = LANE_TOLERANCE, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(parameters, largest gradients, states) of lanes that count each game as often as `copies` [lane, game] says.

    A lane without a row of some class is `nonestimable` and isn't fitted; one whose gradient stays above FINISHED is
    `unconverged`.
    """
    kind, size = packed.model, len(packed.terms)
    theta, gradient = np.zeros((len(penalties), L.parameter_count(kind, size))), np.full(len(penalties), np.nan)
    known = ((copies @ class_counts(packed).T) > 0).all(axis=1)
    at = np.flatnonzero(known)
    for part in some_lanes(len(at), kind, size):
        some = at[part]
        theta[some], _, gradient[some], _ = L.minimise(packed.rows, kind, size, penalties[some], copies[some], None if start is None else start[some], tolerance=tolerance)
    states = ["nonestimable" if not k else "complete" if g <= FINISHED else "unconverged" for k, g in zip(known, gradient)]
    return theta, gradient, states


def choose_penalties(packed: L.Packed, games: Games, ids: list[int], penalties: list[float], use: np.ndarray) -> tuple[dict[int, list[tuple[float, float, float]]], np.ndarray]:
    """({replicate: (penalty, loss, standard error) of each penalty}, parameters [replicate] that the fold fits of its best one suggest).

    Lanes are (replicate, fold, penalty); `use` [game] are the games that count. Copies of a game stay in its fold. A fold
    outside which a class doesn't occur is an error.
    """
    kind, size, parts = packed.model, len(packed.terms), sorted(set(games.folds[use > 0]))
    counts, curves, starts = class_counts(packed), {}, []
    for number in ids:
        own = games.copies[number] * use
        lanes = [(p, f) for p in penalties for f in parts]
        inside = np.stack([own * (games.folds != f) for _, f in lanes])
        outside = np.stack([own * (games.folds == f) for _, f in lanes])
        if not ((inside @ counts.T) > 0).all():
            raise ValueError(f"A class of {kind} is absent outside a fold of replicate {number}")
        told, theta = np.zeros((len(lanes), 2)), np.zeros((len(lanes), L.parameter_count(kind, size)))
        for part in some_lanes(len(lanes), kind, size):
            theta[part] = L.minimise(packed.rows, kind, size, np.array([p for p, _ in lanes[part]]), inside[part], tolerance=LANE_TOLERANCE)[0]
            told[part] = L.held_out_losses(packed.rows, kind, size, theta[part], outside[part], CLIPS[:1])
        curve = []
        for at, penalty in enumerate(penalties):
            rows, loss = told[at * len(parts) : (at + 1) * len(parts)].T
            mean = float((rows * loss).sum() / rows.sum())
            curve.append((penalty, mean, float((rows * (loss - mean) ** 2).sum() / rows.sum() / (len(parts) - 1)) ** 0.5))
        curves[number] = curve
        best = penalties.index(best_penalty(curve))
        starts.append(theta[best * len(parts) : (best + 1) * len(parts)].mean(axis=0))
    return curves, np.stack(starts)


def replicate_fits(packed: L.Packed, games: Games, ids: list[int], penalties: list[float], use: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], list[float], list[bool]]:
    """(parameters, largest gradients, states, penalties, whether at the grid's edge) of a model's fit in each replicate.

    Several penalties are chosen among by cross-validation in every replicate.
    """
    if len(penalties) == 1:
        chosen, start, edge = [penalties[0]] * len(ids), None, [False] * len(ids)
    else:
        curves, start = choose_penalties(packed, games, ids, penalties, use)
        chosen = [best_penalty(curves[i]) for i in ids]
        edge = [p in (max(penalties), min(penalties)) for p in chosen]
    copies = np.stack([games.copies[i] * use for i in ids])
    return (*fit_lanes(packed, np.array(chosen), copies, start=start), chosen, edge)


def replicate_losses(packed: L.Packed, games: Games, ids: list[int], theta: np.ndarray, use: np.ndarray, clip: float) -> np.ndarray:
    """[replicate, (rows, loss)] of each replicate's fit on its copies of the games that `use` [game] counts."""
    return L.held_out_losses(packed.rows, packed.model, len(packed.terms), theta, np.stack([games.copies[i] * use for i in ids]), (clip,))


def replicate_scores(contests: DataFrame, packed: L.Packed, theta: np.ndarray, lanes: list[int], settings: DataFrame) -> DataFrame:
    """(lane, model, role, player_key, score_type, score) of both roles under each lane's parameters and `settings` (lane, weights, share)."""
    tables, out = centred_tables(packed.terms, packed.model, theta), None
    for role in ROLES:
        found = lane_score_types(lane_outcomes(contests, packed.model, role, packed.terms, tables, lanes), packed.model, role, settings)
        out = found if out is None else out.unionByName(found)
    return out


def weekly_lanes(contests: DataFrame, packed: L.Packed, games: Games, ids: list[int], weeks: list[int], penalties: dict[int, float], weights: dict[int, tuple[float, ...]]) -> tuple[DataFrame, list[tuple]]:
    """(replicate_id, week, model, role, player_key, score) of the replicates' cumulative fits, and each fit's (replicate_id, week, model, state, gradient).

    A lane is a replicate and a week: it counts the replicate's copies of the games up to the week, at the replicate's
    penalty and weights. The population are the contexts of all `contests`. Lanes without a fit have no scores.
    """
    pairs = [(i, w) for i in ids for w in weeks]
    copies = np.stack([games.copies[i] * (games.weeks <= w) for i, w in pairs])
    theta, gradient, states = fit_lanes(packed, np.array([penalties[i] for i, _ in pairs]), copies)
    told = [(i, w, packed.model, s, float(g)) for (i, w), s, g in zip(pairs, states, gradient)]
    spark, kept = contests.sparkSession, [at for at, s in enumerate(states) if s == "complete"]
    undefined = [at for at in kept if packed.model != "win" and any(x is None or x != x for x in weights[pairs[at][0]])]
    for at in undefined:
        told[at] = (*told[at][:3], "nonestimable", told[at][4])
    kept = [at for at in kept if at not in set(undefined)]
    settings = spark.createDataFrame([(at, *pairs[at], [float(x) if x is not None else float("nan") for x in weights[pairs[at][0]]], 1.0) for at in kept], "lane int, replicate_id int, week int, weights array<double>, share double")
    if not kept:
        return spark.createDataFrame([], "replicate_id int, week int, model string, role string, player_key string, score double"), told
    found = replicate_scores(contests, packed, theta[kept], kept, settings).where("score_type in ('standardized_probability', 'expected_severity')")
    return found.join(settings.select("lane", "replicate_id", "week"), "lane").select("replicate_id", "week", "model", "role", "player_key", "score"), told
