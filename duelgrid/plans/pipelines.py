"""The analysis steps in order; each reads its predecessors' stage tables from a folder and writes its own."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelgrid.functions.stats import guarded_percentile
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
from duelgrid.operators.ordinal import OrdinalPath, coefficients_of, ordinal_path
from duelgrid.operators.ridge import RidgeFit, fit_model, one_se_penalty, refit_folds
from duelgrid.operators.scoring import standardized_scores
from duelgrid.params import CLASSES, MODELS, ROLES, THRESHOLDS, Params
from duelgrid.sources.tables import content_hash, read_result, resume, write_table


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def finished(fit: RidgeFit) -> RidgeFit:
    """The fit, unless its solver gave up before the minimum."""
    if fit.status == "unconverged":
        raise ValueError(f"The {fit.model} fit at penalty {fit.penalty} didn't converge: gradient {fit.gradient}")
    return fit


def data_engineering(spark: SparkSession, folder: str, contests: DataFrame, plays: DataFrame, pool: DataFrame, folds: DataFrame, params: Params = Params()) -> None:
    """Check the inputs against the rules, then write them with folds, vocabulary, reference contexts and sample sizes."""
    Q.enforce(Q.matchup_quality(contests))
    Q.enforce(Q.folds_quality(folds, contests, params.folds))
    Q.enforce(Q.play_quality(plays, pool))
    for name, df in (("contests", contests), ("plays", plays), ("pool", pool), ("folds", folds)):
        write_table(df, folder, name)
    held = read_result(spark, folder, "contests")
    leak = C.split_leakage(held, params.train_last_week).first()
    if leak["shared_games"] or leak["shared_plays"] or not leak["later"]:
        raise ValueError("Game leakage at the hold-out split")
    write_table(C.vocabulary(held), folder, "vocabulary")
    write_table(C.sample_sizes(held, params.train_last_week), folder, "sample_sizes")
    contexts = union([C.reference_contexts(held, r).withColumn("role", F.lit(r)) for r in ROLES])
    write_table(contexts, folder, "reference_contexts")
    Q.enforce(Q.reference_quality(read_result(spark, folder, "reference_contexts"), ["model", "role"]))


def _train_plays(spark: SparkSession, folder: str) -> DataFrame:
    return read_result(spark, folder, "plays").where("eligible_primary and split = 'train'")


def outcome_weights(spark: SparkSession, folder: str, params: Params = Params()) -> None:
    """Per-game Gramians, the fixed-effects fit, its weights, and hold-out errors against the context-only fit.

    All eligible plays count, those with an accepted penalty too. A sack effect that isn't estimable, or isn't negative,
    gives no weights and is an error.
    """
    train = _train_plays(spark, folder)
    target = train.select("game_id", "play_id", F.col("epa").alias("y"))
    write_table(G.gramian(D.play_design(train, train, ["game_id", "play_id"]), target, ["game_id", "play_id"], ["game_id"]), folder, "game_gramian")
    cells = read_result(spark, folder, "game_gramian").groupBy("a", "b").agg(F.sum("value").alias("value"))
    fit = G.fit_plays(cells, D.play_levels(train))
    if not fit.estimable.get("N_S", False) or not fit.coefficients["N_S"] < 0:
        raise ValueError("Outcome weights need an estimable negative sack coefficient")
    context = G.fit_plays(cells.where(~F.col("a").isin(*D.COUNTS) & ~F.col("b").isin(*D.COUNTS)), D.play_levels(train))
    table = lambda f: spark.createDataFrame([(t, float(v), bool(f.estimable[t])) for t, v in f.coefficients.items()], "term string, coefficient double, estimable boolean")
    write_table(table(fit), folder, "play_coefficients")
    write_table(spark.createDataFrame([(c, float(w)) for c, w in fit.weights().items()], "cls string, weight double"), folder, "outcome_weights")
    test = read_result(spark, folder, "plays").where("eligible_primary and split = 'test'")
    predict = lambda f, kind, name: D.play_design(test, train, ["play_id"], kind).join(table(f), "term").groupBy("play_id").agg(F.sum(F.col("value") * F.col("coefficient")).alias(name))
    rows = test.select("play_id", "epa", F.lit(1.0).alias("w")).join(predict(fit, "primary", "p"), "play_id").join(predict(context, "context", "b"), "play_id")
    write_table(G.prediction_metrics(rows, "p", "b", "epa", "w"), folder, "play_validation")


def _weights(spark: SparkSession, folder: str, params: Params) -> tuple[float, ...]:
    """The learnt outcome weights; one that isn't defined is an error."""
    found = {r["cls"]: r["weight"] for r in read_result(spark, folder, "outcome_weights").collect()}
    weights = tuple(found.get(c, float("nan")) for c in CLASSES)
    if any(w != w for w in weights):
        raise ValueError(f"Undefined outcome weights: {found}")
    return weights


def player_models(spark: SparkSession, folder: str, penalties: list[float], params: Params = Params()) -> None:
    """Ridge fits of both models on the training weeks and on all rows, with their curves."""
    contests, folds = read_result(spark, folder, "contests"), read_result(spark, folder, "folds")
    tables, curves, summary = [], [], []
    for scope, rows in (("train", contests.where(F.col("week") <= params.train_last_week)), ("full", contests)):
        for model in MODELS:
            fit = finished(fit_model(rows, model, folds, penalties, params=params))
            tables.append(fit.coefficients.withColumn("scope", F.lit(scope)))
            wide = one_se_penalty(fit.curve)
            curves += [(scope, model, p, loss, se, p == fit.penalty, p == wide) for p, loss, se in fit.curve]
            summary.append((scope, model, fit.penalty, wide, fit.boundary, fit.status, fit.gradient))
    write_table(union(tables), folder, "player_coefficients")
    write_table(spark.createDataFrame(curves, "scope string, model string, penalty double, cv_loss double, cv_se double, selected boolean, one_se boolean"), folder, "cv_curves")
    write_table(spark.createDataFrame(summary, "scope string, model string, penalty double, one_se_penalty double, grid_boundary boolean, status string, gradient double"), folder, "model_summary")


def hold_out_chances(contests: DataFrame, coefficients: DataFrame, last_train_week: int = 15) -> DataFrame:
    """(model, play_id, game_id, cls, outcome, p) of the hold-out rows under the fitted coefficients."""
    test, parts = contests.where(F.col("week") > last_train_week), []
    for model in MODELS:
        sample = C.model_sample(test, model)
        eta = D.linear_predictor(D.matchup_design(sample, ["play_id"]), coefficients.where(F.col("model") == model), ["play_id"])
        if model == "win":
            other = eta.select("play_id", F.lit("0").alias("cls"), F.lit(0.0).alias("eta"))
            eta = eta.select("play_id", "cls", "eta").unionByName(other)
        most = eta.groupBy("play_id").agg(F.max("eta").alias("_m"))
        parts_ = eta.join(most, "play_id").withColumn("_e", F.exp(F.col("eta") - F.col("_m")))
        total = parts_.groupBy("play_id").agg(F.sum("_e").alias("_t"))
        outcome = F.col("win_target").cast("int").cast("string") if model == "win" else F.col("severity_outcome")
        rows = sample.select("play_id", "game_id", outcome.alias("outcome"))
        parts.append(parts_.join(total, "play_id").join(rows, "play_id").select(F.lit(model).alias("model"), "play_id", "game_id", "cls", "outcome", (F.col("_e") / F.col("_t")).alias("p")))
    return union(parts)


def season_penalty(spark: SparkSession, folder: str, model: str, scope: str = "full") -> float:
    """The penalty that cross-validation chose for a model."""
    return read_result(spark, folder, "model_summary").where((F.col("scope") == scope) & (F.col("model") == model)).first()["penalty"]


def validation(spark: SparkSession, folder: str, params: Params = Params()) -> None:
    """Hold-out loss of the fits against global shares and smoothed baselines, and calibration bins."""
    contests = read_result(spark, folder, "contests")
    write_table(hold_out_chances(contests, read_result(spark, folder, "player_coefficients").where("scope = 'train'").drop("scope"), params.train_last_week), folder, "holdout_predictions")
    chances = read_result(spark, folder, "holdout_predictions")
    fitted = chances.where("cls = outcome").groupBy("model").agg(F.avg(-F.log(F.greatest("p", F.lit(params.clip)))).alias("model_loss"), F.count(F.lit(1)).alias("test_rows"), F.countDistinct("game_id").alias("test_games"))
    grid = B.hold_out_losses(contests, (*params.comparator_strength.values(), float("inf")), params.train_last_week)
    own = F.when(F.col("model") == "win", params.comparator_strength["win"]).otherwise(params.comparator_strength["severity"])
    named = grid.select("model", F.when(F.col("strength") == float("inf"), "global").when(F.col("strength") == own, "smoothed_matchup").alias("baseline"), F.col("loss").alias("baseline_loss")).where("baseline is not null")
    gain = F.col("baseline_loss") - F.col("model_loss")
    chosen = read_result(spark, folder, "model_summary").where("scope = 'train'").select("model", F.col("penalty").alias("lambda"))
    write_table(named.join(fitted, "model").join(chosen, "model").select("*", gain.alias("improvement"), (100 * gain / F.col("baseline_loss")).alias("percent_improvement")), folder, "validation")
    bins = F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int")
    write_table(chances.groupBy("model", "cls", bins.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_probability"), F.avg((F.col("cls") == F.col("outcome")).cast("double")).alias("observed")), folder, "calibration")


def model_scores(contests: DataFrame, coefficients: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """Fitted scores of both models and roles in the long form that cohorts are ranked in (method bt)."""
    wide = union([standardized_scores(contests, coefficients, m, r, weights, share, credits=True) for m in MODELS for r in ROLES])
    kinds = F.array(
        F.struct(F.lit("coefficient").alias("score_type"), F.col("coefficient").alias("score")),
        F.struct(F.when(F.col("model") == "win", "standardized_probability").otherwise("expected_severity").alias("score_type"), F.col("score").alias("score")),
        *(F.struct(F.when(F.col("model") == "severity", n).alias("score_type"), F.col(c).alias("score")) for n, c in (("credited_coefficient", "credited_coefficient"), ("expected_credited_severity", "credited_score"))),
    )
    long = wide.select("model", "role", "player_key", F.explode(kinds).alias("k")).select("model", "role", "player_key", "k.*").where("score_type is not null")
    seen = C.exposure(contests).select("model", "role", "player_key", F.col("interactions").alias("role_interactions"))
    return long.join(seen, ["model", "role", "player_key"]).withColumn("method", F.lit("bt"))


def rankings(spark: SparkSession, folder: str, honours: DataFrame, params: Params = Params()) -> None:
    """Cohort ranks of fitted and descriptive scores, their agreement and the alignment with honours."""
    contests, weights = read_result(spark, folder, "contests"), _weights(spark, folder, params)
    share = C.sack_share(contests).first()["sack_share"]
    fitted = model_scores(contests, read_result(spark, folder, "player_coefficients").where("scope = 'full'").drop("scope"), weights, share)
    plain = B.baseline_scores(contests, Params(severity_weights=weights), share).drop("expected_outcome")
    labels = R.add_honours(read_result(spark, folder, "vocabulary").select("role", "player_key", "player_name"), honours)
    rated = C.rated_opponents(contests).withColumn("rated_ol", F.lit(True))
    scores = union([fitted, plain]).join(labels.select("role", "player_key", "is_first_team", "is_any_team"), ["role", "player_key"]).join(rated, "player_key", "left").fillna({"rated_ol": False})
    write_table(R.rank_cohorts(scores), folder, "all_rankings")
    write_table(R.rank_cohorts(scores.where("role = 'Rusher' or rated_ol")), folder, "rankings")
    ranked = read_result(spark, folder, "rankings")
    pairs = R.rank_pairs(ranked)
    write_table(pairs, folder, "rank_pairs")
    write_table(R.rank_correlations(pairs), folder, "rank_correlations")
    write_table(R.honours_metrics(ranked), folder, "honours_alignment")
    write_table(R.top_report(ranked, "bt"), folder, "top_report")


def learnt_weights(spark: SparkSession, folder: str, scope: str, ids: list[int]) -> dict[int, list[float]]:
    """The outcome weights of each replicate by class; NaN where one isn't defined."""
    found: dict[int, dict[str, float]] = {i: {} for i in ids}
    for r in read_result(spark, folder, f"{scope}_weights").where(F.col("replicate_id").isin(ids)).collect():
        found[r["replicate_id"]][r["cls"]] = r["weight"]
    return {i: [float("nan") if own.get(c) is None else float(own[c]) for c in CLASSES] for i, own in found.items()}


def draw_fits(spark: SparkSession, folder: str, drawn: DataFrame) -> DataFrame:
    """Outcome regressions of all replicates, from the games' Gramians times their copies."""
    levels = [f"{r['kind']}::{r['level']}" for r in D.play_levels(_train_plays(spark, folder)).collect()]
    cells = G.draw_gramians(read_result(spark, folder, "game_gramian"), drawn).select("replicate_id", "a", "b", "value")
    return G.solve_draws(cells, levels)


def bootstrap(spark: SparkSession, folder: str, penalties: list[float], ids: list[int], params: Params = Params(), scope: str = "ratings", at_once: int = 20) -> None:
    """Replicates of a scope, each learnt anew on its own games: outcome weights, sack credit and both fits.

    Several penalties are chosen among by cross-validation in every replicate (a game's copies stay in its fold), one is
    kept. Scope `ratings` draws from all games and scores all players; `validation` fits the drawn training games and
    tells the loss on the drawn hold-out games. Replicates, folds and penalties are lanes of one fit, `at_once`
    replicates a commit. Committed replicates are kept if inputs, settings and code are the same. A replicate without some
    class, or whose fit doesn't converge, is an error. One whose weights aren't defined has null severity scores, so that
    the intervals' `defined_fraction` tells of it.
    """
    contests, folds = read_result(spark, folder, "contests"), read_result(spark, folder, "folds")
    seed = params.seed + (100_000 if scope == "ratings" else 0)
    write_table(S.bootstrap_draws(read_result(spark, folder, "pool"), max(ids), seed, scope, params.train_last_week), folder, f"{scope}_draws")
    drawn = read_result(spark, folder, f"{scope}_draws")
    write_table(draw_fits(spark, folder, drawn), folder, f"{scope}_epa_draws")
    fits = read_result(spark, folder, f"{scope}_epa_draws")
    write_table(G.draw_weights(fits), folder, f"{scope}_weights")
    write_table(G.coefficient_uncertainty(fits, read_result(spark, folder, "play_coefficients")), folder, f"{scope}_epa_uncertainty")
    write_table(G.coefficient_covariance(fits, list(D.COUNTS)), folder, f"{scope}_epa_covariance")
    write_table(normalization_support(fits), folder, f"{scope}_normalization")
    learnt = learnt_weights(spark, folder, scope, ids)
    controls = "|".join(map(str, (seed, penalties, params, content_hash(contests), content_hash(folds), content_hash(read_result(spark, folder, "game_gramian")))))
    games = N.games_of(contests, drawn, ids, folds)
    use = games.weeks <= params.train_last_week if scope == "validation" else np.ones(len(games.names), bool)
    packed = {m: games.packed(contests, m) for m in MODELS}
    shares = C.model_sample(contests, "severity").where("severity_outcome = 'sack'").join(drawn, "game_id").groupBy("replicate_id").agg((F.sum(F.col("sack_credit") * F.col("copies")) / F.sum("copies")).alias("s"))
    credit = {r["replicate_id"]: r["s"] for r in shares.where(F.col("replicate_id").isin(ids)).collect()}

    def compute(some: list[int]) -> DataFrame:
        states, parts, losses = [], [], []
        settings = spark.createDataFrame([(i, learnt[i], float("nan") if credit.get(i) is None else credit[i]) for i in some], "lane int, weights array<double>, share double")
        for model in MODELS:
            theta, gradient, status, chosen, edge = N.replicate_fits(packed[model], games, some, penalties, use)
            lost = [(i, s) for i, s in zip(some, status) if s != "complete"]
            if lost:
                raise ValueError(f"The {model} fits of replicates {lost} failed; no draw is replaced or left out")
            states += [(i, model, float(p), e, s, float(g)) for i, p, e, s, g in zip(some, chosen, edge, status, gradient)]
            if scope == "validation":
                told = N.replicate_losses(packed[model], games, some, theta, ~use, params.clip)
                losses += [(i, model, float(loss)) for i, (_, loss) in zip(some, told)]
            else:
                parts.append(N.replicate_scores(contests, packed[model], theta, some, settings))
        found = spark.createDataFrame(states, "replicate_id int, model string, penalty double, grid_boundary boolean, status string, gradient double")
        if scope == "validation":
            return found.join(spark.createDataFrame(losses, "replicate_id int, model string, model_loss double"), ["replicate_id", "model"])
        seen = C.exposure(contests).select("model", "role", "player_key", F.col("interactions").alias("role_interactions"))
        mine = drawn.where(F.col("replicate_id").isin(some))
        present = C.participations(C.observations(contests)).join(mine, "game_id").select("replicate_id", "model", "role", "player_key").distinct().withColumn("present_in_draw", F.lit(True))
        scores = union(parts).withColumnRenamed("lane", "replicate_id").join(seen, ["model", "role", "player_key"]).withColumn("method", F.lit("bt"))
        return scores.join(present, ["replicate_id", "model", "role", "player_key"], "left").fillna({"present_in_draw": False}).join(found, ["replicate_id", "model"])

    values = resume(spark, folder, f"{scope}_replicates", controls, ids, compute, at_once)
    for held in packed.values():
        held.rows.unpersist()
    write_table(values.select("replicate_id", "model", "penalty", "grid_boundary", "status", "gradient").distinct(), folder, f"{scope}_bootstrap_diagnostics")
    if scope == "validation":
        fixed = F.when(F.col("model") == "win", params.comparator_strength["win"]).otherwise(params.comparator_strength["severity"])
        losses = W.validation_draw_losses(contests, drawn.where(F.col("replicate_id").isin(ids)), (*params.comparator_strength.values(), float("inf")), params.train_last_week)
        named = losses.withColumn("baseline", F.when(F.col("strength") == float("inf"), "global").when(F.col("strength") == fixed, "smoothed_matchup")).where("baseline is not null")
        gain = F.col("loss") - F.col("model_loss")
        rows = named.join(values.select("replicate_id", "model", "model_loss"), ["replicate_id", "model"]).select("replicate_id", "model", "baseline", "model_loss", F.col("loss").alias("baseline_loss"), gain.alias("improvement"), (100 * gain / F.col("loss")).alias("percent_improvement"))
        write_table(rows, folder, "validation_draw_losses")
        held = W.complete_draws(read_result(spark, folder, "validation_draw_losses"), ["model", "baseline"], len(ids))
        sums = held.groupBy("model", "baseline").agg(*(a.alias(f"{c}_{n}") for c in ("improvement", "percent_improvement") for n, a in (("mean", F.avg(c)), ("q025", F.percentile(c, F.lit(0.025))), ("q975", F.percentile(c, F.lit(0.975))))))
        write_table(R.with_intervals(read_result(spark, folder, "validation"), sums, ["model", "baseline"]), folder, "validation_uncertainty")
        return
    write_table(values, folder, "ratings_scores")
    values = read_result(spark, folder, "ratings_scores")
    point = read_result(spark, folder, "all_rankings").where("method = 'bt' and min_interactions = 0").select("model", "score_type", "role", "player_key", F.col("score").alias("point"))
    whole = W.complete_draws(values, ["model", "score_type", "role", "player_key"], len(ids))
    write_table(R.with_intervals(point, W.rating_intervals(whole), ["model", "score_type", "role", "player_key"]), folder, "rating_uncertainty")
    ranked = read_result(spark, folder, "rankings")
    write_table(R.scoped_rank_intervals(values, ranked, "bt"), folder, "rank_uncertainty")
    pairs = read_result(spark, folder, "rank_pairs")
    write_table(R.paired_rank_uncertainty(pairs, values, "coefficient", "expected_severity", "bt:coefficient", "bt:expected_severity"), folder, "paired_rank_uncertainty")


def normalization_support(fits: DataFrame, term: str = "N_S") -> DataFrame:
    """Whether the sack effect is estimable and surely negative over the draws (term, coefficient, estimable by draw)."""
    rows = fits.where(F.col("term") == term)
    known = F.when(F.col("estimable"), F.col("coefficient"))
    sums = rows.agg(F.avg(F.col("estimable").cast("double")).alias("defined_fraction"), guarded_percentile(known, 0.025).alias("sack_q025"), guarded_percentile(known, 0.975).alias("sack_q975"))
    return sums.withColumn("supported", F.coalesce((F.col("defined_fraction") == 1) & (F.col("sack_q975") < 0), F.lit(False)))


def epa_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, plays, weights): the primary design, protected counts, and only the plays without an accepted penalty.

    All three have the basis and levels of all training plays.
    """
    every = _train_plays(spark, folder)
    rows = []
    for kind, design, train in (("primary", "primary", every), ("protected", "protected", every), ("no_penalty", "primary", every.where("not accepted_penalty"))):
        target = train.select("game_id", "play_id", F.col("epa").alias("y"))
        cells = G.gramian(D.play_design(train, every, ["game_id", "play_id"], design), target, ["game_id", "play_id"], [])
        weights = G.fit_plays(cells, D.play_levels(every)).weights()
        rows.append((kind, train.count(), *(float(weights[c]) for c in CLASSES)))
    return spark.createDataFrame(rows, "kind string, plays long, " + ", ".join(f"w_{c} double" for c in CLASSES))


def baseline_analysis(spark: SparkSession, folder: str, params: Params = Params()) -> None:
    """Ten tables about the baselines: cross-validation, the models' own folds, the hold-out, scores, views and stability."""
    contests, folds = read_result(spark, folder, "contests"), read_result(spark, folder, "folds")
    train = contests.where(F.col("week") <= params.train_last_week)
    write_table(B.fold_losses(contests, folds, last_train_week=params.train_last_week), folder, "baseline_cv_folds")
    write_table(B.cv_summary(read_result(spark, folder, "baseline_cv_folds")), folder, "baseline_cv")
    write_table(B.select_strength(read_result(spark, folder, "baseline_cv")), folder, "baseline_selected")
    curves, refits = read_result(spark, folder, "cv_curves").where("scope = 'train' and selected"), []
    for row in curves.collect():
        refits += [(row["model"], row["penalty"], *part) for part in refit_folds(train, row["model"], folds, row["penalty"], row["cv_loss"], params)]
    write_table(spark.createDataFrame(refits, "model string, penalty double, fold int, rows double, loss_1e15 double, loss_1e5 double"), folder, "baseline_model_cv")
    grid = B.hold_out_losses(contests, last_train_week=params.train_last_week)
    chosen = read_result(spark, folder, "baseline_selected").withColumnRenamed("strength", "selected_strength")
    fixed = F.when(F.col("model") == "win", params.comparator_strength["win"]).otherwise(params.comparator_strength["severity"])
    kind = F.when(F.col("strength") == F.col("selected_strength"), "training_cv_selected").when(F.col("strength") == fixed, "fixed").otherwise("grid")
    write_table(grid.join(chosen, "model").withColumn("kind", kind), folder, "baseline_holdout")
    write_table(B.profile_scores(contests, params), folder, "baseline_profile_scores")
    write_table(C.literal_rates(contests), folder, "literal_rates")
    fitted = read_result(spark, folder, "all_rankings").where("min_interactions = 0")
    wide = fitted.where("model = 'win'").groupBy("role", "player_key").agg(*(F.max(F.when(F.col("comparison_id") == c, F.col("score"))).alias(n) for c, n in (("raw:rate", "raw"), ("shrunken:rate", "shrunken"), ("bt:standardized_probability", "fitted"))))
    ranks, pairs = R.rank_views(read_result(spark, folder, "literal_rates").select("role", "player_key", "literal_rate", "win_interactions").join(wide, ["role", "player_key"]), ["literal_rate", "raw", "shrunken", "fitted"], ["win_interactions"])
    write_table(ranks, folder, "baseline_rank_views")
    write_table(pairs, folder, "baseline_rank_view_pairs")
    labels = fitted.select("role", "player_key", "is_first_team", "is_any_team").distinct()
    write_table(R.view_honours(read_result(spark, folder, "baseline_rank_views"), labels, C.rated_opponents(contests)), folder, "baseline_view_honours")
    scores = read_result(spark, folder, "baseline_profile_scores").where("score is not null and interactions > 0")
    season = F.when(F.col("model") == "win", B.label_of(F.lit(params.season_strength["win"]))).otherwise(B.label_of(F.lit(params.season_strength["severity"])))
    original = scores.where(F.col("strength_label") == season).select("model", "role", "player_key", F.lit("original").alias("comparator"), F.col("score").alias("other"))
    model = fitted.where("comparison_id in ('bt:standardized_probability', 'bt:expected_severity')").select("model", "role", "player_key", F.lit("model").alias("comparator"), F.col("score").alias("other"))
    limits = F.explode(F.array(*(F.lit(t) for t in THRESHOLDS))).alias("min_interactions")
    rows = scores.join(original.unionByName(model), ["model", "role", "player_key"]).select("model", "role", "strength_label", "comparator", "interactions", "score", "other", limits).where("interactions >= min_interactions")
    write_table(R.rank_agreement(rows, ["model", "role", "min_interactions", "strength_label", "comparator"], "score", "other"), folder, "baseline_stability")


def ordinal_analysis(spark: SparkSession, folder: str, penalties: list[float], params: Params = Params()) -> OrdinalPath:
    """The proportional-odds alternative: cross-validated path, scores, agreement with the multinomial model, CV comparison."""
    contests, folds = read_result(spark, folder, "contests"), read_result(spark, folder, "folds")
    path = ordinal_path(contests, folds, penalties, params.folds)
    if not path.fit.converged:
        raise ValueError(f"The ordinal fit didn't converge: gradient {path.fit.gradient}")
    write_table(spark.createDataFrame(path.by_fold, "penalty double, fold int, rows double, loss double"), folder, "ordinal_cv_folds")
    beta, weights = coefficients_of(path.fit, spark), _weights(spark, folder, params)
    share = C.sack_share(contests).first()["sack_share"]
    write_table(union([standardized_scores(contests, beta, "severity", r, weights, share, path.fit.cuts, chances=True) for r in ROLES]), folder, "ordinal_scores")
    multinomial = read_result(spark, folder, "all_rankings").where("model = 'severity' and comparison_id = 'bt:expected_severity'").select("role", "player_key", "min_interactions", F.col("score").alias("multinomial"))
    both = read_result(spark, folder, "ordinal_scores").select("role", "player_key", F.col("score").alias("ordinal")).join(multinomial, ["role", "player_key"])
    if both.count() != multinomial.count():
        raise ValueError("Ordinal and multinomial scores don't have the same players")
    write_table(R.rank_agreement(both, ["role", "min_interactions"], "ordinal", "multinomial"), folder, "ordinal_agreement")
    curve = {p: (loss, se) for p, loss, se in path.curve}
    other = read_result(spark, folder, "cv_curves").where("scope = 'full' and model = 'severity' and selected").first()
    rows = [("ordinal", path.penalty, *curve[path.penalty], path.extensions), ("multinomial", other["penalty"], other["cv_loss"], other["cv_se"], 0)]
    write_table(spark.createDataFrame(rows, "family string, penalty double, cv_loss double, cv_se double, extensions int"), folder, "ordinal_cv_comparison")
    return path


def sensitivity(spark: SparkSession, folder: str, penalties: list[float], params: Params = Params()) -> None:
    """Baselines over all strengths, the proportional-odds alternative, and other play regressions."""
    baseline_analysis(spark, folder, params)
    ordinal_analysis(spark, folder, penalties, params)
    write_table(epa_sensitivity(spark, folder), folder, "epa_sensitivity")


def _week_scores(spark: SparkSession, folder: str, contests: DataFrame, seen: DataFrame, week: int, model: str, weights: tuple[float, ...], share: float, params: Params, weight=None) -> tuple[DataFrame | None, tuple]:
    """One week's scores of a model at the season's penalty against the season's population, and the fit's state."""
    fit = fit_model(seen, model, fixed=season_penalty(spark, folder, model), params=params, weight=weight)
    state = (week, model, fit.status, float(fit.gradient))
    if fit.status == "nonestimable":
        return None, state
    scores = union([standardized_scores(seen, finished(fit).coefficients, model, r, weights, share, reference=contests) for r in ROLES])
    return K.exposed(scores, seen, week).withColumn("week", F.lit(week)), state


def weekly(spark: SparkSession, folder: str, weeks: list[int], params: Params = Params()) -> None:
    """Cumulative fits at the season's penalty, weights and population, by week; the last week is the season's own fit.

    Players without a row of the model up to a week have no score in it. Raw rates are put beside the scores.
    """
    contests, weights = read_result(spark, folder, "contests"), _weights(spark, folder, params)
    share = C.sack_share(contests).first()["sack_share"]
    season, parts, states = read_result(spark, folder, "player_coefficients").where("scope = 'full'").drop("scope"), [], []
    for week in weeks:
        for model in MODELS:
            if week == params.last_week:
                scores = union([standardized_scores(contests, season, model, r, weights, share) for r in ROLES])
                parts.append(K.exposed(scores, contests, week).withColumn("week", F.lit(week)))
                states.append((week, model, "season", 0.0))
                continue
            scores, state = _week_scores(spark, folder, contests, contests.where(F.col("week") <= week), week, model, weights, share, params)
            states.append(state)
            if scores is not None:
                parts.append(scores)
    write_table(K.weekly_raw(contests), folder, "weekly_raw")
    raw = read_result(spark, folder, "weekly_raw").select(F.lit("win").alias("model"), "role", "player_key", "week", "raw_score", "allocated_raw_score")
    write_table(union(parts).join(raw, ["model", "role", "player_key", "week"], "left"), folder, "weekly_scores")
    write_table(spark.createDataFrame(states, "week int, model string, status string, gradient double"), folder, "weekly_point_diagnostics")


def weekly_uncertainty(spark: SparkSession, folder: str, weeks: list[int], ids: list[int], params: Params = Params(), at_once: int = 20) -> None:
    """Weekly fits of the rating replicates: intervals by week and player, absences and the fits' states.

    A replicate and a week are a lane: at the replicate's penalty and weights, on its copies of the games up to the week,
    against the season's population. All replicates and weeks of a commit are one fit a model. The last week takes the
    scores that the replicate already has. All players seen up to a week have a score in every draw; an interval needs
    all draws. raw_lower and raw_upper are bounds of the draws' raw rates, where all draws have one.
    """
    contests, drawn = read_result(spark, folder, "contests"), read_result(spark, folder, "ratings_draws")
    learnt = learnt_weights(spark, folder, "ratings", ids)
    chosen: dict[str, dict[int, float]] = {m: {} for m in MODELS}
    for r in read_result(spark, folder, "ratings_bootstrap_diagnostics").where(F.col("replicate_id").isin(ids)).collect():
        chosen[r["model"]][r["replicate_id"]] = r["penalty"]
    controls = "|".join(map(str, (weeks, params, content_hash(contests), content_hash(drawn), sorted(learnt.items()), chosen)))
    games, fitted = N.games_of(contests, drawn, ids), [w for w in weeks if w != params.last_week]
    packed = {m: games.packed(contests, m) for m in MODELS}

    def compute(some: list[int]) -> DataFrame:
        parts, told = [], []
        for model in MODELS:
            if fitted:
                scores, states = N.weekly_lanes(contests, packed[model], games, some, fitted, chosen[model], learnt)
                parts.append(scores)
                told += states
        out = spark.createDataFrame(told, "replicate_id int, week int, model string, status string, gradient double")
        if any(s == "unconverged" for *_, s, _ in told):
            raise ValueError("A weekly fit of a replicate didn't converge")
        return out.join(union(parts), ["replicate_id", "week", "model"], "left") if parts else out.withColumns({"role": F.lit(None).cast("string"), "player_key": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})

    values = resume(spark, folder, "weekly_replicates", controls, ids, compute, at_once)
    for held in packed.values():
        held.rows.unpersist()
    if params.last_week in weeks:
        last = read_result(spark, folder, "ratings_scores").where(F.col("score_type").isin("standardized_probability", "expected_severity") & F.col("replicate_id").isin(ids))
        status = F.when(F.col("score").isNull(), "nonestimable").otherwise("complete")
        values = values.unionByName(last.select("replicate_id", "model", "role", "player_key", "score", F.lit(params.last_week).alias("week"), status.alias("status"), F.lit(None).cast("double").alias("gradient")))
    write_table(values.groupBy("replicate_id", "week", "model").agg(F.max("status").alias("status"), F.count("player_key").alias("players")), folder, "weekly_bootstrap_diagnostics")
    mine = drawn.where(F.col("replicate_id").isin(ids))
    write_table(K.weekly_availability(contests, mine).where(F.col("week").isin(weeks)), folder, "weekly_availability")
    write_table(K.weekly_summary(contests, mine, values, read_result(spark, folder, "weekly_availability"), len(ids)), folder, "weekly_uncertainty")
    write_table(K.weekly_report(read_result(spark, folder, "weekly_uncertainty")), folder, "weekly_report")


def plot_tables(spark: SparkSession, folder: str, players: int = 5) -> None:
    """The tables behind three figures: penalty curves, calibration, and the weekly lines of the best players."""
    curves = read_result(spark, folder, "cv_curves")
    write_table(curves.select("scope", "model", F.log10("penalty").alias("log10_penalty"), "cv_loss", (F.col("cv_loss") - F.col("cv_se")).alias("low"), (F.col("cv_loss") + F.col("cv_se")).alias("high"), "selected"), folder, "plot_cv_curves")
    bins = read_result(spark, folder, "calibration")
    write_table(bins.select("model", "cls", "bin", "rows", "mean_probability", "observed", (F.col("observed") - F.col("mean_probability")).alias("gap")), folder, "plot_calibration")
    lines = read_result(spark, folder, "weekly_scores")
    last = lines.agg(F.max("week").alias("_last"))
    best = lines.crossJoin(F.broadcast(last)).where("week = _last").withColumn("place", F.row_number().over(Window.partitionBy("model", "role").orderBy(F.desc_nulls_last("score"), "player_key"))).where(F.col("place") <= players)
    write_table(lines.join(best.select("model", "role", "player_key", "place"), ["model", "role", "player_key"]).select("model", "role", "player_key", "place", "week", "score", "raw_score"), folder, "plot_weekly")


def tuned_validation(spark: SparkSession, folder: str, ids: list[int], params: Params = Params()) -> None:
    """Tuned and fixed baselines on the validation draws, each paired with the model refitted on the same draw."""
    contests, folds = read_result(spark, folder, "contests"), read_result(spark, folder, "folds")
    drawn = read_result(spark, folder, "validation_draws").where(F.col("replicate_id").isin(ids))
    saved = read_result(spark, folder, "validation_draw_losses").select("replicate_id", "model", "model_loss").distinct()
    write_table(W.tuned_validation(W.validation_draw_losses(contests, drawn, last_train_week=params.train_last_week), W.draw_cv_losses(contests, drawn, folds, last_train_week=params.train_last_week), saved), folder, "tuned_baseline_validation_draws")
    found = read_result(spark, folder, "tuned_baseline_validation_draws")
    grid, model = read_result(spark, folder, "baseline_holdout"), read_result(spark, folder, "validation").select("model", "model_loss").distinct()
    kinds = F.array(F.lit("fixed_grid"), F.when(F.col("strength") == F.col("selected_strength"), "training_cv_selected"))
    rows = grid.join(model, "model").select("*", F.explode(kinds).alias("baseline")).where("baseline is not null")
    gain = F.col("loss") - F.col("model_loss")
    comparison = F.when(F.col("baseline") == "training_cv_selected", F.col("baseline")).otherwise(B.label_of(F.col("strength")))
    write_table(rows.select("model", "baseline", comparison.alias("comparison"), gain.alias("improvement"), (100 * gain / F.col("loss")).alias("percent_improvement")), folder, "tuned_baseline_validation_point")
    write_table(W.validation_summary(found, read_result(spark, folder, "tuned_baseline_validation_point"), len(ids)), folder, "tuned_baseline_validation_summary")
    write_table(W.selected_frequencies(found, len(ids)), folder, "tuned_baseline_selected_frequencies")
