"""The registered queries of the rating engine: each reads the given tables and returns one result table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.functions.scalars import name_key as name_key_of
from duelgrid.functions.scalars import softmax
from duelgrid.operators import baselines as B
from duelgrid.operators import contests as C
from duelgrid.operators import design as D
from duelgrid.operators import draws as W
from duelgrid.operators import quality as Q
from duelgrid.operators import ranking as R
from duelgrid.operators import regression as G
from duelgrid.operators import replicates as N
from duelgrid.operators import resample as S
from duelgrid.operators import weekly as K
from duelgrid.operators.ordinal import TOLERANCE, coefficients_of, fit_ordinal, ordinal_groups
from duelgrid.operators.quality import matchup_quality as matchup_rules
from duelgrid.operators.quality import play_quality as play_rules
from duelgrid.operators.ridge import fit_model, weekly_fits
from duelgrid.operators.scoring import lane_scores
from duelgrid.operators.scoring import standardized_scores as population_scores
from duelgrid.params import CLASSES, MODELS, ROLES, Params
from duelgrid.sources import adapter as A
from duelgrid.sources.stage import kept

PARAMS = Params()
#: Replicates of the registered bootstrap queries that don't take `Params.draws`; the operators take any number.
DRAWS, TUNING_DRAWS = 20, 4
DIGITS = 6
#: Decimals of large sums, whose last digits depend on the order of addition.
SUM_DIGITS = 3


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to some decimals (no negative zero), so that results can be compared between engines."""
    return df.select(*(F.round(F.col(f.name), digits).__add__(F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


def hashed(*parts: Column) -> Column:
    """A fixed coefficient in [-0.5, 0.5) from the md5 of its names."""
    return S.hash_number(*parts) / F.lit(4294967296.0) - 0.5


def sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return C.sample_sizes(A.contests(spark, sf))


def matchup_quality(spark: SparkSession, sf: str) -> DataFrame:
    return matchup_rules(A.contests(spark, sf))


def play_quality(spark: SparkSession, sf: str) -> DataFrame:
    return play_rules(A.plays(spark, sf), A.game_pool(spark, sf))


def folds_quality(spark: SparkSession, sf: str) -> DataFrame:
    return Q.folds_quality(A.folds(spark, sf), A.contests(spark, sf), PARAMS.folds)


def reference_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of both reference populations: weights of a model add up to 1."""
    contests = A.contests(spark, sf)
    parts = [C.reference_contexts(contests, r).select("model", F.lit(r).alias("role"), "weight") for r in ROLES]
    return Q.reference_quality(parts[0].unionByName(parts[1]), ["model", "role"])


def result_quality(spark: SparkSession, sf: str) -> DataFrame:
    draws = S.bootstrap_draws(A.game_pool(spark, sf), TUNING_DRAWS, PARAMS.seed)
    losses = W.validation_draw_losses(A.contests(spark, sf), draws)
    return Q.result_quality(B.baseline_scores(A.contests(spark, sf)), _rating_draws(spark, sf), _predictions(spark, sf), losses, DRAWS)


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return C.vocabulary(A.contests(spark, sf))


def rated_opponents(spark: SparkSession, sf: str) -> DataFrame:
    return C.rated_opponents(A.contests(spark, sf))


def exposure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.exposure(A.contests(spark, sf)))


def sack_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.sack_share(A.contests(spark, sf)))


def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_leakage(A.contests(spark, sf))


def outcome_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.outcome_profiles(A.contests(spark, sf)))


def smoothed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    strength = F.when(F.col("model") == "win", 25.0).otherwise(50.0)
    profiles = C.outcome_profiles(A.contests(spark, sf))
    return rounded(profiles.select("model", "role", "player_key", "cls", C.smooth(F.col("mass"), F.col("total"), F.col("share"), strength).alias("smoothed")))


def baseline_logloss(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out loss of the smoothed-count baseline at its fixed strength against the global shares."""
    found = B.hold_out_losses(A.contests(spark, sf), (25.0, 50.0, float("inf")))
    fixed = F.when(F.col("model") == "win", 25.0).otherwise(50.0)
    wide = found.groupBy("model").agg(
        F.max(F.when(F.col("strength") == float("inf"), F.col("loss"))).alias("global_loss"), F.max(F.when(F.col("strength") == fixed, F.col("loss"))).alias("smoothed_loss"), F.max("test_rows").alias("test_rows"), F.max("test_games").alias("test_games")
    )
    gain = F.col("global_loss") - F.col("smoothed_loss")
    return rounded(wide.select("*", gain.alias("improvement"), (100 * gain / F.col("global_loss")).alias("percent_improvement")))


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("strength", B.label_of(F.col("strength")))


def baseline_loss_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_labelled(B.hold_out_losses(A.contests(spark, sf))))


def baseline_cv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_labelled(B.fold_losses(A.contests(spark, sf), A.folds(spark, sf))))


def baseline_cv_selected(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(B.select_strength(B.cv_summary(B.fold_losses(A.contests(spark, sf), A.folds(spark, sf)))))


def reference_contexts_rusher(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.reference_contexts(A.contests(spark, sf), "Rusher"))


def reference_contexts_blocker(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.reference_contexts(A.contests(spark, sf), "Blocker"))


def literal_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.literal_rates(A.contests(spark, sf)))


def profile_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.profile_scores(A.contests(spark, sf)).drop("strength"))


def baseline_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.baseline_scores(A.contests(spark, sf)))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    # scores are compared at a fixed precision, so that ties are the same in any summation order
    return R.rank_cohorts(rounded(B.baseline_scores(A.contests(spark, sf))))


def rank_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_ranked(spark, sf).drop("method", "score_type", "expected_outcome"))


def top10_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.top_report(_ranked(spark, sf), "shrunken", 100))


def rank_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.rank_pairs(_ranked(spark, sf)))


def rank_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.rank_correlations(R.rank_pairs(_ranked(spark, sf))))


def _players(spark: SparkSession, sf: str) -> DataFrame:
    return C.vocabulary(A.contests(spark, sf)).select("role", "player_key", "player_name")


def honours_alignment(spark: SparkSession, sf: str) -> DataFrame:
    players = _players(spark, sf)
    labels = R.add_honours(players, A.honours(players)).select("role", "player_key", "is_first_team", "is_any_team")
    return rounded(R.honours_metrics(_ranked(spark, sf).join(labels, ["role", "player_key"])))


def honours_labels(spark: SparkSession, sf: str) -> DataFrame:
    players = _players(spark, sf)
    return R.add_honours(players, A.honours(players))


def _views(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Literal, raw and shrunken win scores side by side."""
    contests = A.contests(spark, sf)
    literal = rounded(C.literal_rates(contests)).select("role", "player_key", "literal_rate", "win_interactions")
    scores = rounded(B.baseline_scores(contests)).where("model = 'win'").groupBy("role", "player_key").agg(F.max(F.when(F.col("method") == "raw", F.col("score"))).alias("raw"), F.max(F.when(F.col("method") == "shrunken", F.col("score"))).alias("shrunken"))
    return R.rank_views(literal.join(scores, ["role", "player_key"]), ["literal_rate", "raw", "shrunken"], ["win_interactions"])


def rank_views(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_views(spark, sf)[0])


def rank_view_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_views(spark, sf)[1])


def rank_view_honours(spark: SparkSession, sf: str) -> DataFrame:
    players = _players(spark, sf)
    labels = R.add_honours(players, A.honours(players))
    return rounded(R.view_honours(_views(spark, sf)[0], labels, C.rated_opponents(A.contests(spark, sf))))


def rating_table(spark: SparkSession, sf: str) -> DataFrame:
    """Shrunken point scores with the intervals of their draws."""
    points = rounded(B.baseline_scores(A.contests(spark, sf))).where("method = 'shrunken'").select("model", "score_type", "role", "player_key", "role_interactions", "score")
    intervals = W.rating_intervals(_rating_draws(spark, sf)).select("model", "score_type", "role", "player_key", "q025", "q975", "top10_probability")
    return rounded(R.with_intervals(points, intervals, ["model", "score_type", "role", "player_key"]))


def ranking_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks at every strength against those at the season's strength and those by the model score, by cohort."""
    scores = rounded(B.profile_scores(A.contests(spark, sf))).where("score is not null")
    original = F.when(F.col("model") == "win", "2").otherwise("10")
    base = scores.where(F.col("strength_label") == original).select("model", "role", "player_key", F.lit("original").alias("comparator"), F.col("score").alias("original"))
    base = base.unionByName(standardized_scores(spark, sf).select("model", "role", "player_key", F.lit("model").alias("comparator"), F.col("score").alias("original")))
    limits = F.explode(F.array(*(F.lit(t) for t in (0, 100, 200, 400)))).alias("min_interactions")
    rows = scores.where("interactions > 0").join(base, ["model", "role", "player_key"]).select("model", "role", "strength_label", "interactions", "score", "comparator", "original", limits).where("interactions >= min_interactions")
    return rounded(R.rank_agreement(rows, ["model", "role", "min_interactions", "strength_label", "comparator"], "score", "original"))


def name_key(spark: SparkSession, sf: str) -> DataFrame:
    names = A.table(spark, sf, "customer").select(F.concat_ws("  ", "c_name", F.lit("O'Hara-"), "c_mktsegment").alias("name"))
    return names.select(name_key_of(F.col("name")).alias("name_key")).groupBy("name_key").agg(F.count(F.lit(1)).alias("n"))


def design_triplets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.matchup_design(A.contests(spark, sf), ["play_id"]))


def design_row_mass(spark: SparkSession, sf: str) -> DataFrame:
    role = F.split("term", "::")[0]
    return rounded(D.matchup_design(A.contests(spark, sf), ["play_id"]).groupBy("play_id", role.alias("part")).agg(F.sum("value").alias("mass")))


def _plays(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible plays, those with an accepted penalty too."""
    return A.plays(spark, sf).where("eligible_primary")


def play_basis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.play_basis(_plays(spark, sf).where("split = 'train'")))


def play_levels(spark: SparkSession, sf: str) -> DataFrame:
    return D.play_levels(_plays(spark, sf).where("split = 'train'"))


def play_design(spark: SparkSession, sf: str) -> DataFrame:
    rows = _plays(spark, sf)
    return rounded(D.play_design(rows, rows.where("split = 'train'"), ["play_id"]))


def _game_gramian(spark: SparkSession, sf: str) -> DataFrame:
    train = _plays(spark, sf).where("split = 'train'")
    return G.row_gramian(D.play_rows(train, train), ["game_id"], "epa")


def game_gramian(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_game_gramian(spark, sf), SUM_DIGITS)


def play_gramian(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_game_gramian(spark, sf).groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("rows").alias("rows")), SUM_DIGITS)


def bootstrap_gramian(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.draw_gramians(_game_gramian(spark, sf), bootstrap_draws(spark, sf)), SUM_DIGITS)


def game_folds(spark: SparkSession, sf: str) -> DataFrame:
    return A.folds(spark, sf)


def bootstrap_draws(spark: SparkSession, sf: str) -> DataFrame:
    return S.bootstrap_draws(A.game_pool(spark, sf), DRAWS, PARAMS.seed)


def _rating_draws(spark: SparkSession, sf: str) -> DataFrame:
    draws = S.bootstrap_draws(A.game_pool(spark, sf), DRAWS, PARAMS.seed + 100_000, "ratings")
    return rounded(W.bootstrap_scores(A.contests(spark, sf), draws, share=0.5), 9)


def bootstrap_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.rating_intervals(_rating_draws(spark, sf)))


def scoped_rank_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.scoped_rank_intervals(_rating_draws(spark, sf), _ranked(spark, sf), "shrunken"))


def paired_rank_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    types = ("expected_credited_severity", "expected_severity")
    return rounded(R.paired_rank_uncertainty(R.rank_pairs(_ranked(spark, sf)), _rating_draws(spark, sf), *types, *(f"shrunken:{t}" for t in types)))


def _tuning(spark: SparkSession, sf: str, count: int) -> DataFrame:
    contests, fold_map = A.contests(spark, sf), A.folds(spark, sf)
    draws = kept(S.bootstrap_draws(A.game_pool(spark, sf), count, PARAMS.seed), "draws")
    test = kept(W.validation_draw_losses(contests, draws), "draw-losses")
    fixed = F.when(F.col("model") == "win", 25.0).otherwise(50.0)
    saved = test.where(F.col("strength") == fixed).select("replicate_id", "model", F.col("loss").alias("model_loss"))
    return W.tuned_validation(test, W.draw_cv_losses(contests, draws, fold_map), saved)


def bootstrap_baseline_losses(spark: SparkSession, sf: str) -> DataFrame:
    draws = S.bootstrap_draws(A.game_pool(spark, sf), TUNING_DRAWS, PARAMS.seed)
    return rounded(_labelled(W.validation_draw_losses(A.contests(spark, sf), draws)))


def bootstrap_baseline_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of the improvements of the fixed and the tuned baselines over all replicates of `Params.draws`."""
    return rounded(W.validation_summary(_tuning(spark, sf, PARAMS.draws)))


def tuned_baseline_table(spark: SparkSession, sf: str) -> DataFrame:
    """Point improvements of the fixed and the tuned baselines over the comparator, each with its paired interval over all replicates of `Params.draws`."""
    contests = A.contests(spark, sf)
    grid = B.hold_out_losses(contests)
    fixed = F.when(F.col("model") == "win", 25.0).otherwise(50.0)
    model = grid.where(F.col("strength") == fixed).select("model", F.col("loss").alias("model_loss"))
    chosen = B.select_strength(B.cv_summary(B.fold_losses(contests, A.folds(spark, sf)))).withColumnRenamed("strength", "chosen")
    kinds = F.array(F.lit("fixed_grid"), F.when(F.col("strength") == F.col("chosen"), "training_cv_selected"))
    rows = grid.join(model, "model").join(chosen, "model").select("*", F.explode(kinds).alias("baseline")).where("baseline is not null")
    comparison = F.when(F.col("baseline") == "training_cv_selected", F.col("baseline")).otherwise(B.label_of(F.col("strength")))
    gain = F.col("loss") - F.col("model_loss")
    point = rows.select("model", "baseline", comparison.alias("comparison"), gain.alias("improvement"), (100 * gain / F.col("loss")).alias("percent_improvement"))
    return rounded(W.validation_summary(_tuning(spark, sf, PARAMS.draws), point, PARAMS.draws))


def selected_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_labelled(W.selected_frequencies(_tuning(spark, sf, TUNING_DRAWS), TUNING_DRAWS)))


def weekly_raw(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.weekly_raw(A.contests(spark, sf)))


def weekly_availability(spark: SparkSession, sf: str) -> DataFrame:
    draws = S.bootstrap_draws(A.game_pool(spark, sf), 5, PARAMS.seed + 100_000, "ratings")
    return K.weekly_availability(A.contests(spark, sf), draws)


def weekly_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals over replicates of a player's sampled share of interactions, by week."""
    draws = S.bootstrap_draws(A.game_pool(spark, sf), 5, PARAMS.seed + 100_000, "ratings")
    rows = K.weekly_availability(A.contests(spark, sf), draws)
    rows = rows.withColumn("ratio", F.when(F.col("present_in_draw"), F.col("sampled_interactions") / F.col("observed_interactions")))
    return rounded(K.weekly_intervals(rows, ["week", "model", "role", "player_key"], "ratio", 5))


def weekly_absence(spark: SparkSession, sf: str) -> DataFrame:
    return K.absence_counts(weekly_availability(spark, sf), 5)


def weekly_report(spark: SparkSession, sf: str) -> DataFrame:
    return K.weekly_report(weekly_intervals(spark, sf))


def ordinal_design_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ordinal_groups(A.contests(spark, sf)).withColumn("keys", F.array_join("keys", "|"))


def _fixed_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients from hashes of model, term and class, for every player of the vocabulary; written, for they are read several times."""
    return A.derived(spark, sf, "fixed-coefficients", _hashed_coefficients)


def _hashed_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    players = _players(spark, sf).select(F.concat(F.lower("role"), F.lit("::"), "player_key").alias("term"))
    fixed = spark.createDataFrame([("(Intercept)",), ("double_team",), ("double_team_unknown",)], "term string")
    pairs = F.explode(F.array(F.struct(F.lit("win").alias("model"), F.lit("1").alias("cls")), *(F.struct(F.lit("severity").alias("model"), F.lit(c).alias("cls")) for c in CLASSES))).alias("p")
    rows = players.unionByName(fixed).select("term", pairs).select("p.model", "term", "p.cls")
    return rows.withColumn("coefficient", hashed(F.col("model"), F.col("term"), F.col("cls")))


def centered_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.center_coefficients(_fixed_coefficients(spark, sf)))


def standardized_scores(spark: SparkSession, sf: str) -> DataFrame:
    contests, beta = A.contests(spark, sf), _fixed_coefficients(spark, sf)
    parts = [population_scores(contests, beta, m, r, PARAMS.severity_weights, 0.5) for m in ("win", "severity") for r in ("Rusher", "Blocker")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def ordinal_scores(spark: SparkSession, sf: str) -> DataFrame:
    contests, beta = A.contests(spark, sf), _fixed_coefficients(spark, sf)
    one = beta.where("model = 'win'").withColumn("model", F.lit("severity"))
    parts = [population_scores(contests, one, "severity", r, PARAMS.severity_weights, 0.5, [0.0, 1.2, 2.2], chances=True) for r in ("Rusher", "Blocker")]
    return rounded(parts[0].unionByName(parts[1]))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Class probabilities of the hold-out contests under the fixed coefficients: one column a class."""
    contests, beta = A.contests(spark, sf).where("week > 15"), _fixed_coefficients(spark, sf).where("model = 'severity'")
    sample = C.model_sample(contests, "severity")
    eta = D.linear_predictor(D.matchup_design(sample, ["play_id"]), beta, ["play_id"])
    wide = eta.groupBy("play_id").agg(*(F.sum(F.when(F.col("cls") == c, F.col("eta"))).alias(c) for c in CLASSES))
    chances = softmax([F.col(c) for c in CLASSES])
    return sample.select("play_id", "game_id", "severity_outcome").join(wide.select("play_id", *(p.alias(f"p_{c}") for c, p in zip(CLASSES, chances))), "play_id")


def holdout_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_predictions(spark, sf))


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, mean probability and observed share in ten bins of each class's probability."""
    long = _predictions(spark, sf).select("severity_outcome", F.explode(F.array(*(F.struct(F.lit(c).alias("outcome"), F.col(f"p_{c}").alias("p")) for c in CLASSES))).alias("e"))
    bins = F.least(F.lit(9), F.floor(F.col("e.p") * 10)).cast("int")
    return rounded(long.groupBy(F.col("e.outcome").alias("outcome"), bins.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg("e.p").alias("mean_probability"), F.avg((F.col("severity_outcome") == F.col("e.outcome")).cast("double")).alias("observed")))


def loss_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Log-loss under two clips, clipped counts and extremes of the hold-out probabilities."""
    rows = _predictions(spark, sf)
    own = F.element_at(F.create_map(*[x for c in CLASSES for x in (F.lit(c), F.col(f"p_{c}"))]), F.col("severity_outcome"))
    every = F.array(*(F.col(f"p_{c}") for c in CLASSES))
    beyond = lambda p: (p < 1e-5) | (p > 1 - 1e-5)
    return rounded(
        rows.select(own.alias("own"), every.alias("every")).agg(
            F.avg(-F.log(F.greatest("own", F.lit(1e-15)))).alias("loss_1e15"),
            F.avg(-F.log(F.least(F.greatest("own", F.lit(1e-5)), F.lit(1 - 1e-5)))).alias("loss_1e5"),
            F.sum(F.size(F.filter("every", beyond))).alias("clipped"),
            F.count_if(beyond(F.col("own"))).alias("clipped_observed"),
            F.min(F.array_min("every")).alias("smallest"),
            F.max(F.array_max("every")).alias("largest"),
        )
    )


def play_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out errors of a hash-weighted linear predictor against the training mean."""
    plays = _plays(spark, sf)
    train = plays.where("split = 'train'")
    test = plays.where("split = 'test'")
    design = D.play_design(test, train, ["play_id"])
    value = design.groupBy("play_id").agg(F.sum(F.col("value") * hashed(F.col("term"))).alias("primary"))
    mean = train.agg(F.avg("epa").alias("baseline"))
    rows = test.select("play_id", "epa", (1 + F.col("down") % 2).cast("double").alias("weight")).join(value, "play_id").crossJoin(F.broadcast(mean))
    return rounded(G.prediction_metrics(rows, "primary", "baseline", "epa", "weight"))


def _fit_rows(spark: SparkSession, fit) -> DataFrame:
    return spark.createDataFrame([(t, float(c), bool(fit.estimable[t])) for t, c in fit.coefficients.items()], "term string, coefficient double, estimable boolean")


def play_fit(spark: SparkSession, sf: str) -> DataFrame:
    train = _plays(spark, sf).where("split = 'train'")
    cells = _game_gramian(spark, sf).groupBy("a", "b").agg(F.sum("value").alias("value"))
    return _fit_rows(spark, G.fit_plays(cells, D.play_levels(train)))


def play_fit_residual(spark: SparkSession, sf: str) -> DataFrame:
    """What the fit leaves at every term: 0 for a least-squares fit, whatever the terms it set to 0."""
    cells = _game_gramian(spark, sf).groupBy("a", "b").agg(F.sum("value").alias("value"))
    return rounded(G.normal_residuals(cells, play_fit(spark, sf)), 5)


def _epa_fits(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame, DataFrame, G.FixedEffectsFit]]:
    """(kind, plays, Gramian, fit) of the primary design, the protected counts, and the plays without penalties alone."""
    every = _plays(spark, sf).where("split = 'train'")
    levels, out = kept(D.play_levels(every), "epa-levels"), []
    for kind, design, train in (("primary", "primary", every), ("protected", "protected", every), ("no_penalty", "primary", every.where("not accepted_penalty"))):
        # terms x terms, read by the fit and four times by the residuals: the plays behind them are worked through once
        cells = kept(G.row_gramian(D.play_rows(train, every, design), [], "epa").select("a", "b", "value"), "epa-gramian")
        fit = G.fit_plays(cells, levels)
        out.append((kind, train, cells, fit))
    return out


def epa_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome weights and plays of the primary design, the protected counts, and the plays without accepted penalties alone."""
    rows = [(kind, train.count(), *(float(fit.weights()[c]) for c in CLASSES)) for kind, train, _, fit in _epa_fits(spark, sf)]
    return rounded(spark.createDataFrame(rows, "kind string, plays long, " + ", ".join(f"w_{c} double" for c in CLASSES)))


def epa_sensitivity_check(spark: SparkSession, sf: str) -> DataFrame:
    """Plays, terms and the largest residual of the normal equations of each of these fits."""
    parts = []
    for kind, train, cells, fit in _epa_fits(spark, sf):
        left = G.normal_residuals(cells, _fit_rows(spark, fit)).agg(F.count(F.lit(1)).alias("terms"), F.round(F.max(F.abs("residual")), 5).alias("residual"))
        parts.append(train.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("plays")).crossJoin(left))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _level_names(spark: SparkSession, sf: str) -> list[str]:
    return [f"{r['kind']}::{r['level']}" for r in D.play_levels(_plays(spark, sf).where("split = 'train'")).collect()]


def _draw_fits(spark: SparkSession, sf: str) -> DataFrame:
    """(replicate_id, term, coefficient, estimable, absent) of the regressions of all replicates."""
    drawn = G.draw_gramians(_game_gramian(spark, sf), bootstrap_draws(spark, sf)).select("replicate_id", "a", "b", "value")
    return G.solve_draws(drawn, _level_names(spark, sf))


def coefficient_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    """Every term over the replicates' regressions: point, mean, quantiles, identified interval, defined and absent shares."""
    return rounded(G.coefficient_uncertainty(_draw_fits(spark, sf), play_fit(spark, sf)))


def coefficient_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """Covariance of the count terms' coefficients over the replicates."""
    return rounded(G.coefficient_covariance(_draw_fits(spark, sf), list(D.COUNTS)), 9)


def bootstrap_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome weights learnt anew in every replicate."""
    return rounded(G.draw_weights(_draw_fits(spark, sf)))


def bootstrap_weights_check(spark: SparkSession, sf: str) -> DataFrame:
    """Terms and the largest residual of the normal equations by replicate, for all replicates of `Params.draws`."""
    draws = S.bootstrap_draws(A.game_pool(spark, sf), PARAMS.draws, PARAMS.seed)
    # as many cells as replicates x pairs of terms, whatever the number of plays: written once, read by the fits and by the sums
    drawn = kept(G.draw_gramians(_game_gramian(spark, sf), draws).select("replicate_id", "a", "b", "value"), "draw-gramians")
    fits = G.solve_draws(drawn, _level_names(spark, sf))
    sides = drawn.where("a <> '@y' and b <> '@y'")
    turned = sides.where("a <> b").select("replicate_id", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    fitted = sides.unionByName(turned).join(fits.select("replicate_id", F.col("term").alias("b"), "coefficient"), ["replicate_id", "b"]).groupBy("replicate_id", "a").agg(F.sum(F.col("value") * F.col("coefficient")).alias("f"))
    target = drawn.where("(a = '@y') <> (b = '@y')").select("replicate_id", F.when(F.col("a") == "@y", F.col("b")).otherwise(F.col("a")).alias("a"), F.col("value").alias("y"))
    length = sides.where("a = b").select("replicate_id", "a", F.sqrt("value").alias("n"))
    met = fitted.join(length, ["replicate_id", "a"]).join(target, ["replicate_id", "a"], "left")
    return met.groupBy("replicate_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max(F.abs(F.coalesce("y", F.lit(0.0)) - F.col("f")) / F.col("n")), 4).alias("residual"))


def ridge_win(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fit_model(A.contests(spark, sf), "win", A.folds(spark, sf), PARAMS.penalty_grid()).coefficients)


def ridge_severity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fit_model(A.contests(spark, sf), "severity", fixed=0.01).coefficients)


def ordinal_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of the proportional-odds fit, its largest gradient and whether that is below the tolerance."""
    fit = fit_ordinal(A.contests(spark, sf), 0.01, TOLERANCE)
    return rounded(coefficients_of(fit, spark)).withColumn("gradient", F.lit(fit.gradient)).withColumn("converged", F.lit(fit.converged))


def ridge_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """Terms and largest gradient of the penalised loss of both models' fits at one penalty: 0 at the minimum."""
    rows = []
    for model in MODELS:
        fit = fit_model(A.contests(spark, sf), model, fixed=0.01)
        rows.append((model, len(fit.terms), round(fit.gradient, 3) + 0.0))
    return spark.createDataFrame(rows, "model string, terms int, gradient double")


def weekly_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised scores of both models' cumulative fits at one penalty, for every week, of the players seen so far.

    A model of which a class hasn't occurred yet has no scores in that week.
    """
    contests, weeks, parts = A.contests(spark, sf), list(range(1, PARAMS.last_week + 1)), []
    for model in MODELS:
        terms, tables, status = weekly_fits(contests, model, 0.01, weeks)
        kept = [i for i, w in enumerate(weeks) if status[w] == "complete"]
        parts += [lane_scores(contests, model, r, terms, tables[kept], [weeks[i] for i in kept], PARAMS.severity_weights) for r in ROLES]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rounded(K.exposed_by_week(out, contests, PARAMS.last_week))


def _rating_lanes(spark: SparkSession, sf: str, count: int) -> tuple[DataFrame, DataFrame, N.Games, dict[int, list[float]]]:
    """(contests, draws, games, outcome weights of each replicate) of the rating replicates."""
    contests = A.contests(spark, sf)
    draws = S.bootstrap_draws(A.game_pool(spark, sf), count, PARAMS.seed + 100_000, "ratings")
    ids = list(range(1, count + 1))
    fits = G.solve_draws(G.draw_gramians(_game_gramian(spark, sf), draws).select("replicate_id", "a", "b", "value"), _level_names(spark, sf))
    learnt = {(r["replicate_id"], r["cls"]): r["weight"] for r in G.draw_weights(fits).collect()}
    nan = float("nan")
    weights = {i: [nan if learnt.get((i, c)) is None else learnt[i, c] for c in CLASSES] for i in ids}
    return contests, draws, N.games_of(contests, draws, ids, A.folds(spark, sf)), weights


def model_rating_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of the fitted scores of both models over the rating replicates, at one penalty and the weights of each replicate."""
    contests, _, games, weights = _rating_lanes(spark, sf, DRAWS)
    ids, parts = list(games.copies), []
    settings = spark.createDataFrame([(i, weights[i], 0.5) for i in ids], "lane int, weights array<double>, share double")
    for model in MODELS:
        packed = games.packed(contests, model)
        theta, _, _, _, _ = N.replicate_fits(packed, games, ids, [0.01], np.ones(len(games.names), bool))
        parts.append(N.replicate_scores(contests, packed, theta, ids, settings))
        packed.rows.unpersist()
    present = games.present(contests)
    scores = parts[0].unionByName(parts[1]).withColumnRenamed("lane", "replicate_id")
    return rounded(W.rating_intervals(scores.join(present, ["replicate_id", "model", "role", "player_key"], "left").fillna({"present_in_draw": False})), 4)


QUERIES = {f.__name__: f for f in (
    sample_sizes, matchup_quality, play_quality, folds_quality, reference_quality, result_quality, vocabulary, rated_opponents, exposure, sack_share, split_leakage, outcome_profiles, smoothed_profiles,
    baseline_logloss, baseline_loss_grid, baseline_cv, baseline_cv_selected, reference_contexts_rusher, reference_contexts_blocker, literal_rates,
    profile_scores, baseline_scores, rank_cohorts, top10_report, rank_pairs, rank_correlations, honours_labels, honours_alignment, rank_views,
    rank_view_pairs, rank_view_honours, rating_table, ranking_stability, name_key, design_triplets, design_row_mass, play_basis, play_levels, play_design, game_gramian, play_gramian,
    bootstrap_gramian, game_folds, bootstrap_draws, bootstrap_ratings, scoped_rank_intervals, paired_rank_uncertainty, bootstrap_baseline_losses,
    bootstrap_baseline_summary, selected_frequencies, tuned_baseline_table, weekly_raw, weekly_availability, weekly_absence, weekly_intervals, weekly_report, ordinal_design_groups,
    centered_coefficients, standardized_scores, ordinal_scores, holdout_predictions, calibration_bins, loss_audit, play_metrics, play_fit,
    play_fit_residual, epa_sensitivity, epa_sensitivity_check, coefficient_uncertainty, coefficient_covariance, bootstrap_weights, bootstrap_weights_check,
    ridge_gradient, ridge_win, ridge_severity, ordinal_fit, weekly_scores, model_rating_draws,
)}
