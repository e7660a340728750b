"""Invariants of the rating operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.operators import baselines as B
from duelgrid.operators import contests as C
from duelgrid.operators import design as D
from duelgrid.operators import lanes as L
from duelgrid.operators import quality as Q
from duelgrid.operators import draws as W
from duelgrid.operators import ranking as R
from duelgrid.operators import resample as S
from duelgrid.operators import weekly as K
from duelgrid.operators.ordinal import extend_grid, fit_ordinal, ordinal_path
from duelgrid.operators.regression import solve_fixed_effects
from duelgrid.operators.ridge import best_penalty, fit_model, one_se_penalty, refit_folds, weekly_fits
from duelgrid.operators.scoring import lane_scores, standardized_scores
from duelgrid.params import Params
from duelgrid.sources import adapter as A
from duelgrid.sources.tables import group_apply, json_text, read_folds, read_matchups, read_reference, read_result, resume, utc_time, write_table


@pytest.fixture(scope="module")
def contests(spark, sf):
    return A.contests(spark, sf).cache()


def test_design_mass_and_member_order(contests):
    design = D.matchup_design(contests, ["play_id"])
    mass = design.groupBy("play_id", F.split("term", "::")[0].alias("part")).agg(F.sum("value").alias("m"))
    assert mass.where("part = 'rusher' and m <> 1").count() == 0
    assert mass.where("part = 'blocker' and abs(m + 1) > 1e-12").count() == 0
    turned = contests.withColumn("blocker_keys", F.reverse("blocker_keys"))
    assert D.matchup_design(turned, ["play_id"]).exceptAll(design).count() == 0


def test_reference_weights_add_up(contests):
    for role in ("Rusher", "Blocker"):
        for row in C.reference_contexts(contests, role).groupBy("model").agg(F.sum("weight").alias("w")).collect():
            assert row.w == pytest.approx(1, abs=1e-10)


def test_centering_keeps_predictions(spark, contests):
    terms = [r.term for r in D.matchup_design(contests, ["play_id"]).select("term").distinct().collect()]
    rng = np.random.default_rng(1)
    beta = spark.createDataFrame([("win", t, "1", float(rng.normal())) for t in [*terms, "(Intercept)"]], "model string, term string, cls string, coefficient double")
    centred = D.center_coefficients(beta)
    design = D.matchup_design(contests, ["play_id"])
    a, b = (D.linear_predictor(design, c, ["play_id"]) for c in (beta, centred))
    assert a.join(b.withColumnRenamed("eta", "other"), ["play_id", "cls"]).agg(F.max(F.abs(F.col("eta") - F.col("other")))).first()[0] < 1e-9
    means = centred.where("term like 'rusher::%'").agg(F.avg("coefficient")).first()[0]
    assert abs(means) < 1e-12


def test_draws_do_not_depend_on_the_schedule(spark, sf):
    pool = A.game_pool(spark, sf)
    one = S.bootstrap_draws(pool, 3, 7)
    two = S.bootstrap_draws(pool.repartition(7), 3, 7)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    more = S.bootstrap_draws(pool, 5, 7).where("replicate_id <= 3")
    assert more.exceptAll(one).count() == 0
    totals = {(r.replicate_id, r.s): r.n for r in one.join(pool, "game_id").groupBy("replicate_id", (F.col("week") <= 15).alias("s")).agg(F.sum("copies").alias("n")).collect()}
    sizes = {r.s: r.n for r in pool.groupBy((F.col("week") <= 15).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(n == sizes[s] for (_, s), n in totals.items())


def test_folds_are_balanced(spark, sf):
    counts = [r["count"] for r in A.folds(spark, sf).groupBy("fold").count().collect()]
    assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_tuning_does_not_see_the_hold_out(spark, sf, contests):
    folds = A.folds(spark, sf)
    strengths = (2.0, 50.0, math.inf)
    plain = B.fold_losses(contests, folds, strengths)
    turned = contests.withColumn("win_target", F.when(F.col("week") > 15, 1 - F.col("win_target")).otherwise(F.col("win_target")))
    keys = ["fold", "model", "strength"]
    rows = lambda df: {tuple(r[k] for k in keys): (r["loss"], r["test_rows"], r["test_games"]) for r in df.collect()}
    one, two = rows(plain), rows(B.fold_losses(turned, folds, strengths))
    assert one.keys() == two.keys()
    # sums of the same doubles in another order
    assert all(abs(one[k][0] - two[k][0]) < 1e-12 and one[k][1:] == two[k][1:] for k in one)


def brute_loss(train, test, strength):
    """Loss of the win baseline by plain Python."""
    share = sum(c == "1" for c, _, _ in train) / len(train)
    masses = {}
    for cls, focal, keys in train:
        for key, m in [(("r", focal), 1.0), *((("b", k), 1 / len(keys)) for k in keys)]:
            held = masses.setdefault(key, [0.0, 0.0])
            held[int(cls)] += m

    def profile(key):
        m = masses.get(key)
        if m is None:
            return [1 - share, share]
        return [(m[i] + strength * (share if i else 1 - share)) / (sum(m) + strength) for i in (0, 1)]

    out = []
    for cls, focal, keys in test:
        r = profile(("r", focal))
        b = [math.exp(sum(math.log(max(profile(("b", k))[i], 1e-15)) for k in keys) / len(keys)) for i in (0, 1)]
        p = [math.sqrt(r[i] * b[i]) for i in (0, 1)]
        out.append(-math.log(p[int(cls)] / sum(p)))
    return sum(out) / len(out)


def test_losses_against_brute_force(contests):
    rows = C.observations(contests).where("model = 'win'")
    take = lambda d: [(r.cls, r.rusher_key, list(r.blocker_keys)) for r in d.select("cls", "rusher_key", "blocker_keys").collect()]
    train, test = rows.where("week <= 3"), rows.where("week = 18")
    found = {r.strength: r.loss for r in B.losses(train, test, [], (1.0, 25.0)).collect()}
    for strength in (1.0, 25.0):
        assert found[strength] == pytest.approx(brute_loss(take(train), take(test), strength), abs=1e-12)


def test_quality_rules_find_planted_faults(contests):
    clean = {r.rule: r.violations for r in Q.matchup_quality(contests).collect()}
    assert not any(clean.values())
    bad = contests.withColumn("double_team", F.when(F.col("play_id") == contests.first().play_id, 2).otherwise(F.col("double_team")))
    bad = bad.unionByName(contests.limit(1)).withColumn("severity_outcome", F.when(F.col("severity_outcome") == "sack", "loss").otherwise(F.col("severity_outcome")))
    found = {r.rule: r.violations for r in Q.matchup_quality(bad).collect()}
    assert found["V07_help"] >= 1 and found["V15_unique"] == 1 and found["V12_category"] > 0
    with pytest.raises(ValueError, match="V07_help"):
        Q.enforce(Q.matchup_quality(bad))


def test_last_week_is_the_season(contests):
    last = K.weekly_raw(contests).where("week = 18").select("role", "player_key", "interactions", "games")
    season = C.participations(C.model_sample(contests, "win")).groupBy("role", "player_key").agg(F.count(F.lit(1)).alias("interactions"), F.countDistinct("game_id").alias("games"))
    assert last.exceptAll(season).count() == 0 and season.exceptAll(last).count() == 0


def test_fixed_effects_against_least_squares():
    rng = np.random.default_rng(5)
    n, names = 400, ["(Intercept)", "N_S", *(f"QB::{i}" for i in range(4)), *(f"DEF::{i}" for i in range(3))]
    x = np.zeros((n, len(names)))
    x[:, 0], x[:, 1] = 1, rng.normal(size=n)
    q, d = rng.integers(0, 4, n), rng.integers(0, 3, n)
    x[np.arange(n), 2 + q] = 1
    x[np.arange(n), 6 + d] = 1
    y = 0.3 - 2 * x[:, 1] + np.array([0.1, -0.2, 0.3, 0])[q] + np.array([0.5, -0.5, 0.2])[d] + rng.normal(scale=0.02, size=n)
    gram, right = x.T @ x, x.T @ y
    cells = [(names[i], names[j], gram[i, j]) for i in range(len(names)) for j in range(i, len(names))] + [("@y", t, v) for t, v in zip(names, right)]
    fit = solve_fixed_effects(cells, [*names[2:], "QB::unseen"])
    best = np.linalg.lstsq(x, y, rcond=None)[0]
    ours = x @ np.array([fit.coefficients[t] for t in names])
    assert np.abs(ours - x @ best).max() < 1e-8
    assert fit.coefficients["N_S"] == pytest.approx(-2, abs=0.035)
    assert sum(fit.coefficients[t] for t in names[2:6]) == pytest.approx(0, abs=1e-10)
    assert fit.absent == ("QB::unseen",) and not fit.estimable["QB::unseen"] and fit.estimable["N_S"]


@pytest.mark.parametrize("kind", ["win", "severity", "ordinal"])
def test_gradients_are_derivatives(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), float(rng.integers(1, 5)), int(rng.integers(0, 2 if kind == "win" else 4)), [0, 1 + i % 2], [1.0, float(rng.normal())]) for i in range(40)]
    packed = spark.createDataFrame(rows, "fold int, weight double, label int, at array<int>, value array<double>").cache()
    theta = rng.normal(size=(2, L.parameter_count(kind, 3))) / 2
    left, penalties = np.array([-1, 1]), np.array([0.1, 0.3])
    loss, slope = L.evaluate(packed, kind, 3, theta, left, penalties)
    for i in range(theta.shape[1]):
        up = theta.copy()
        up[:, i] += 1e-6
        assert (L.evaluate(packed, kind, 3, up, left, penalties)[0] - loss) / 1e-6 == pytest.approx(slope[:, i], rel=1e-3, abs=1e-5)
    fitted, low, gradient, _ = L.minimise(packed, kind, 3, penalties, left, tolerance=1e-7)
    assert gradient.max() < 1e-7 and (low <= loss).all()


def test_lanes_agree_with_mllib(contests):
    """The fit of all rows at one penalty is the same minimum by either solver."""
    rows = contests.where("week <= 8")
    for model in ("win", "severity"):
        packed = L.pack(rows, model)
        theta, loss, gradient, _ = L.minimise(packed.rows.cache(), model, len(packed.terms), np.array([0.02]), np.array([-1]), tolerance=1e-7)
        fit = fit_model(rows, model, fixed=0.02)
        assert fit.status == "complete" and fit.gradient < 1e-4 and set(fit.terms) == set(packed.terms)
        heads = L.head_count(model)
        ours = theta[0].reshape(heads, -1)[:, :-1]
        centred = ours - ours.mean(axis=0) if heads > 1 else ours
        for name, values in zip(("1",) if heads == 1 else ("loss", "win", "pressure", "sack"), centred):
            rushers = {t: v for t, v in zip(packed.terms, values) if t.startswith("rusher::")}
            mean = sum(rushers.values()) / len(rushers)
            held = {r.term: r.coefficient for r in fit.coefficients.where(f"cls = '{name}'").collect()}
            assert all(held[t] == pytest.approx(v - mean, abs=2e-3) for t, v in rushers.items())


def test_weeks_side_by_side(contests):
    """A week's lane is the fit of its rows, and lane scores are the standardised scores."""
    rows = contests.where("week <= 6")
    for model in ("win", "severity"):
        terms, tables, status = weekly_fits(rows, model, 0.02, [4, 6])
        assert status == {4: "complete", 6: "complete"}
        names = ("1",) if model == "win" else C.classes_of(model)
        long = [(model, t, n, float(v)) for n, values in zip(names, tables[1]) for t, v in zip([*terms, "(Intercept)"], values)]
        beta = contests.sparkSession.createDataFrame(long, "model string, term string, cls string, coefficient double")
        for role in ("Rusher", "Blocker"):
            wanted = {r.player_key: r.score for r in standardized_scores(rows, beta, model, role, (0.0, 0.25, 0.5, 1.0)).collect()}
            found = lane_scores(rows, model, role, terms, tables, [4, 6], (0.0, 0.25, 0.5, 1.0)).where("week = 6").collect()
            assert len(found) == len(wanted) and all(r.score == pytest.approx(wanted[r.player_key], abs=1e-9) for r in found)
            fitted = {r.player_key: r.score for r in standardized_scores(rows, fit_model(rows, model, fixed=0.02).coefficients, model, role, (0.0, 0.25, 0.5, 1.0)).collect()}
            assert all(r.score == pytest.approx(fitted[r.player_key], abs=2e-3) for r in found)


def test_cross_validation_and_fold_refits(spark, sf, contests):
    rows, folds = contests.where("week <= 10"), A.folds(spark, sf)
    fit = fit_model(rows, "win", folds, [0.3, 0.03, 0.003], params=Params(tolerance=1e-6))
    assert [p for p, _, _ in fit.curve] == [0.3, 0.03, 0.003] and fit.penalty == best_penalty(fit.curve) and len(fit.folds) == 5
    loss = next(value for p, value, _ in fit.curve if p == fit.penalty)
    parts = refit_folds(rows, "win", folds, fit.penalty, loss)
    assert [p[0] for p in parts] == [1, 2, 3, 4, 5] and sum(p[1] * p[2] for p in parts) / sum(p[1] for p in parts) == pytest.approx(loss, abs=1e-9)
    with pytest.raises(ValueError, match="agree"):
        refit_folds(rows, "win", folds, fit.penalty, loss + 1e-3)
    with pytest.raises(Exception, match="No fold for game"):
        fit_model(rows, "win", folds.where("fold < 5"), [0.1])
    one_fold = rows.withColumn("severity_outcome", F.when((F.col("severity_outcome") == "sack") & (F.col("game_id") != rows.first().game_id), "loss").otherwise(F.col("severity_outcome")))
    with pytest.raises(ValueError, match="outside fold"):
        fit_model(one_fold, "severity", folds, [0.1])


def test_ordinal_path_extends_its_grid(spark, sf, contests):
    path = ordinal_path(contests.where("week <= 6"), A.folds(spark, sf), [1e-3, 3e-4], 5)
    assert path.fit.converged and path.extensions >= 1 and path.penalty == min(path.curve, key=lambda c: (c[1], -c[0]))[0]
    assert path.one_se >= path.penalty and len(path.by_fold) == 5 * len(path.curve)


def test_ordinal_fit_converges(contests):
    fit = fit_ordinal(contests.where("week <= 4"), 0.05)
    assert fit.converged and fit.cuts == sorted(fit.cuts)
    assert extend_grid([1.0, 0.1], "upper") == pytest.approx([10.0, 1.0, 0.1])


def test_ridge_states_and_penalty_rules(contests):
    one_class = contests.where("win_target = 1 and week <= 2")
    assert fit_model(one_class, "win", fixed=0.1).status == "nonestimable"
    fit = fit_model(contests.where("week <= 6"), "win", fixed=0.5, params=Params(tolerance=1e-6))
    assert fit.status == "complete" and fit.coefficients.count() == len(fit.terms) + 1
    curve = [(1.0, 0.70, 0.02), (0.1, 0.69, 0.02), (0.01, 0.69, 0.02), (0.001, 0.80, 0.02)]
    assert best_penalty(curve) == 0.1 and one_se_penalty(curve) == 1.0


def test_csv_round_trip_and_resume(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    head = "game_id,play_id,game_index,week,kickoff_utc,rusher_id,rusher_name,blocker_ids,blocker_names,blocker_rated_ol,double_team,double_team_unknown,complete_timing,win_target,severity_outcome,sack_credit,early_model_eligible,strict_recorded_pressure,extra\n"
    with open(path, "w") as out:
        out.write(head + '007,1,1,1,2021-09-09T20:20:00Z,101,Ann,"[""201"",""202""]","[""B"",""C""]","[1,0]",1,0,TRUE,NA,,0,0,0,x\n')
    row = read_matchups(spark, path).first()
    assert row.game_id == "007" and row.blocker_keys == ["id:201", "id:202"] and row.win_target is None and row.severity_outcome is None
    assert row.blocker_rated_ol == [1, 0] and row.group_size == 2 and row.kickoff.year == 2021
    with open(path, "w") as out:
        out.write(head.replace("week,", "") + "1\n")
    with pytest.raises(ValueError, match="week"):
        read_matchups(spark, path)
    folder, calls = str(tmp_path / "out"), []

    def compute(some):
        calls.extend(some)
        return spark.createDataFrame([(n, n * 1.0) for n in some if n != 2], "replicate_id int, score double")

    assert resume(spark, folder, "draws", "a", [1, 2], compute, 2).count() == 1
    # a replicate without rows is done, and is not computed again
    assert resume(spark, folder, "draws", "a", [1, 2, 3], compute).count() == 2 and calls == [1, 2, 3]
    assert resume(spark, folder, "draws", "a", [3], compute).collect() == [(3, 3.0)] and calls == [1, 2, 3]

    def killed(some):
        return compute(some).withColumn("score", F.when(F.col("replicate_id") == 5, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("score")))

    with pytest.raises(Exception, match="killed"):
        resume(spark, folder, "draws", "a", [4, 5, 6], killed, 1)
    # what was committed stays, what was not leaves nothing
    assert sorted(r.replicate_id for r in resume(spark, folder, "draws", "a", [1, 3, 4, 5, 6], compute, 4).collect()) == [1, 3, 4, 5, 6]
    assert calls == [1, 2, 3, 4, 5, 5, 6]
    with pytest.raises(ValueError, match="fresh"):
        resume(spark, folder, "draws", "b", [1, 2, 3, 4], compute)
    write_table(spark.range(3), folder, "t")
    assert read_result(spark, folder, "t").count() == 3
    with pytest.raises(FileNotFoundError, match="earlier"):
        read_result(spark, folder, "none")


def violated(rules):
    return {r.rule: r.violations for r in rules.collect() if r.violations}


def test_fold_and_reference_rules(spark, sf, contests, tmp_path):
    folds = A.folds(spark, sf)
    assert violated(Q.folds_quality(folds, contests, 5)) == {}
    one = folds.first().game_id
    assert violated(Q.folds_quality(folds.where(F.col("game_id") != one), contests, 5)) == {"F03_games": 1}
    assert violated(Q.folds_quality(folds.unionByName(folds.limit(1)), contests, 5)) == {"F01_unique": 1}
    assert violated(Q.folds_quality(folds.where("fold < 5").unionByName(folds.where("fold = 5").withColumn("fold", F.lit(7))), contests, 5)) == {"F02_labels": 2}
    path = str(tmp_path / "folds")
    folds.write.csv(path, header=True)
    assert read_folds(spark, path, contests, 5).exceptAll(folds).count() == 0
    contexts = C.reference_contexts(contests, "Rusher")
    assert violated(Q.reference_quality(contexts, ["model"])) == {}
    assert violated(Q.reference_quality(contexts.withColumn("weight", F.col("weight") * 1.1), ["model"])) == {"R02_sum": 2}
    assert "R01_positive" in violated(Q.reference_quality(contexts.withColumn("weight", -F.col("weight")), ["model"]))
    contexts.write.parquet(str(tmp_path / "contexts"))
    assert read_reference(spark, str(tmp_path / "contexts"), ["model"]).count() == contexts.count()


def test_result_rules(spark):
    scores = spark.createDataFrame([("win", "Rusher", p, "raw", "rate") for p in "aab"], "model string, role string, player_key string, method string, score_type string")
    draws = spark.createDataFrame([(r, "win", "rate", "Rusher", p, True) for r, p in ((1, "a"), (1, "b"), (3, "a"))], "replicate_id int, model string, score_type string, role string, player_key string, present_in_draw boolean")
    chances = spark.createDataFrame([(0.5, 0.5), (0.5, 0.4), (None, 1.0)], "p_a double, p_b double")
    losses = spark.createDataFrame([(1, "win", 1.0, 5), (1, "win", 2.0, 6)], "replicate_id int, model string, strength double, test_rows long")
    assert violated(Q.result_quality(scores, draws, chances, losses, 2)) == {"X01_score_key": 1, "X02_replicates": 2, "X03_grid": 1, "X05_probabilities": 2, "X06_paired": 1}


def test_points_need_intervals_and_draws_must_be_complete(spark):
    points = spark.createDataFrame([("win", 1.0), ("severity", 2.0)], "model string, score double")
    intervals = spark.createDataFrame([("win", 0.5)], "model string, low double")
    assert R.with_intervals(points.where("model = 'win'"), intervals, ["model"]).first().low == 0.5
    with pytest.raises(Exception, match="No interval for severity"):
        R.with_intervals(points, intervals, ["model"]).collect()
    draws = spark.createDataFrame([("win", 1), ("win", 2), ("severity", 1)], "model string, replicate_id int")
    assert W.complete_draws(draws.where("model = 'win'"), ["model"], 2).count() == 2
    with pytest.raises(Exception, match="Incomplete draws of severity"):
        W.complete_draws(draws, ["model"], 2).collect()


def test_times_json_and_groups(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = spark.createDataFrame([("2021-09-09T20:20:00Z",), ("2021-09-09T20:20:00",), ("2021-09-09T22:20:00+02:00",), (None,)], "t string")
        assert [r[0] for r in texts.select(F.unix_timestamp(utc_time(F.col("t")))).collect()] == [1631218800] * 3 + [None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert spark.createDataFrame([(["b", "a"],)], "x array<string>").select(json_text(F.col("x"))).first()[0] == '["a","b"]'
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 5.0)], "g int, x double")
    assert sorted(r.x for r in group_apply(rows, ["g"], lambda part: part[["x"]].mean().to_frame().T, "x double").collect()) == [3.0, 5.0]
    with pytest.raises(ValueError, match="h"):
        group_apply(rows, ["h"], lambda part: part, "x double")


def test_derived_tables_are_written_once(spark, sf):
    first, second = A.contests(spark, sf), A.contests(spark, sf)
    assert first.inputFiles() == second.inputFiles() and first.exceptAll(A.derive_contests(spark, sf)).count() == 0
