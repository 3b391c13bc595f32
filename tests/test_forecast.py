import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cellpulse.operators import diagnostics as DG
from cellpulse.operators import features as FE
from cellpulse.operators import forecast as FC
from cellpulse.operators import kpi as K
from cellpulse.operators import metrics as M
from cellpulse.operators import models as MO
from cellpulse.operators.quality import PanelError
from tests.fixtures import panel_frame, spec_hourly, two_season

SPLITS = (("train", 28), ("validation", 7), ("test", 7), ("stress", 7))


@pytest.fixture(scope="module")
def world(spark):
    spec = spec_hourly(49, n_areas=2, splits=SPLITS)
    n = 49 * 24
    series = {1: two_season(n, noise=2.0), 2: two_season(n, noise=4.0, seed=1, level=300.0)}
    labelled = FE.assign_split(panel_frame(spark, series, spec), spec).cache()
    return spec, series, labelled


def forecasts(spark, observed, predicted, persistence=None, start="2013-12-16", model="m"):
    n = len(observed)
    base = persistence if persistence is not None else np.concatenate([[observed[0]], observed[:-1]])
    pdf = pd.DataFrame(
        {"area": 1, "split": "test", "model": model, "t_index": np.arange(n), "local": pd.date_range(start, periods=n, freq="h"),
         "observed": observed, "persistence": base, "predicted": predicted}
    )
    return spark.createDataFrame(pdf, "area long, split string, model string, t_index long, local timestamp_ntz, observed double, persistence double, predicted double")


def test_walk_forward_keeps_the_history(world):
    spec, series, labelled = world
    for model, lag in ((FC.persistence(), 1), (FC.seasonal_naive(spec), 24)):
        rows = FC.walk_forward(model, labelled, spec, "test").filter("area = 1").orderBy("t_index").toPandas()
        first = 35 * 24
        assert list(rows["t_index"]) == list(range(first, first + 168))
        np.testing.assert_allclose(rows["predicted"], series[1][first - lag : first - lag + 168])
        assert FC.need_history(FC.walk_forward(model, labelled, spec, "test")).count() == 0


def test_metric_identities(spark, world):
    spec, series, labelled = world
    scale = M.mase_scale(labelled, spec)
    x = series[1]
    assert scale.filter("area = 1").first()[1] == pytest.approx(np.abs(x[24 : 28 * 24] - x[: 28 * 24 - 24]).mean())
    y = np.array([0.0, 0.5, 2.0, 4.0, 10.0])
    p = np.array([0.0, 1.0, 1.0, 5.0, 12.0])
    row = M.metric_table(forecasts(spark, y, p).withColumn("seed", F.lit(0)), scale, spec).first()
    e = p - y
    assert row["mae"] == pytest.approx(np.abs(e).mean())
    assert row["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert row["bias"] == pytest.approx(e.mean())
    assert row["mape"] == pytest.approx(100 * np.mean(np.abs(e[1:]) / y[1:]))
    assert row["mape_excl_small"] == pytest.approx(100 * np.mean(np.abs(e[2:]) / y[2:]))
    assert row["n_small"] == 2
    assert row["smape"] == pytest.approx(100 * np.mean([0, *(2 * np.abs(e[1:]) / (y + p)[1:])]))
    assert row["wape"] == pytest.approx(100 * np.abs(e).sum() / y.sum())
    assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    flat = M.metric_table(forecasts(spark, np.zeros(5), np.zeros(5)).withColumn("seed", F.lit(0)), scale, spec).first()
    assert (flat["mape"], flat["wape"], flat["r2"], flat["smape"]) == (None, None, None, 0.0)


def test_exactly_periodic_training_has_no_mase(spark):
    spec = spec_hourly(49, n_areas=1, splits=SPLITS)
    labelled = FE.assign_split(panel_frame(spark, {1: np.tile(np.arange(24.0), 49)}, spec), spec)
    assert M.mase_violations(M.mase_scale(labelled, spec)).count() == 1


def test_seed_ensemble_and_spread(spark, world):
    spec, _, labelled = world
    preds = FC.baseline_predictions(labelled, spec, blends=(0.2, 0.5, 0.8))
    single = M.metric_table(preds.filter("model = 'blend'"), M.mase_scale(labelled, spec), spec)
    spread = M.seed_spread(single).filter("area = 1 AND split = 'test'").first()
    maes = [r["mae"] for r in single.filter("area = 1 AND split = 'test'").collect()]
    assert spread["n_seeds"] == 3
    assert spread["mae"] == pytest.approx(np.mean(maes)) and spread["mae_std"] == pytest.approx(np.std(maes, ddof=1))
    one = M.seed_spread(single.filter("seed = 0")).first()
    assert one["mae_std"] == 0.0
    ens = M.metric_table(FC.seed_ensemble(preds, "blend"), M.mase_scale(labelled, spec), spec).filter("area = 1 AND split = 'test'").first()
    assert ens["mae"] <= spread["mae"] + 1e-9
    cost = FC.ensemble_cost(spark.createDataFrame([(1, "test", "lstm", 2.0, 0.5, 10), (1, "test", "lstm", 3.0, 0.5, 10)], "area long, split string, model string, train_wall_s double, inference_wall_s double, n_params long")).first()
    assert (cost["model"], cost["train_wall_s"], cost["n_params"]) == ("lstm_ensemble", 5.0, 20)


def test_selections_merge_but_never_mix_areas(spark):
    schema = "model string, tuning_area int, score double"
    kept = spark.createDataFrame([("a", 5, 1.0), ("b", 5, 2.0)], schema)
    got = {r["model"]: r["score"] for r in FC.merge_selections(kept, spark.createDataFrame([("b", 5, 9.0)], schema)).collect()}
    assert got == {"a": 1.0, "b": 9.0}
    with pytest.raises(PanelError):
        FC.merge_selections(kept, spark.createDataFrame([("b", 6, 9.0)], schema))


def diag(n=336):
    t = np.arange(n)
    return 500 + 200 * np.sin(2 * np.pi * t / 24) + 20 * np.cos(2 * np.pi * t / 7)


def test_errors_by_hour_and_day(spark):
    y = diag()
    p = y.copy()
    hour = np.arange(len(y)) % 24
    p[hour == 5] += 30
    df = forecasts(spark, y, p)
    hours = {r["hour"]: (r["mae"], r["n"]) for r in DG.error_by_hour(df).collect()}
    assert len(hours) == 24 and hours[5] == (pytest.approx(30.0), 14) and hours[4] == (0.0, 14)
    part = {r["hour"]: r for r in DG.error_by_hour(df.filter("hour(local) < 3")).collect()}
    assert part[10]["mae"] is None and part[10]["n"] == 0
    heat = DG.error_heatmap(df.filter("t_index < 24")).collect()
    assert len(heat) == 168 and sum(r["n"] for r in heat) == 24
    assert {r["weekday"] for r in heat if r["n"]} == {0}
    q = y + np.where((np.arange(len(y)) // 24) % 7 >= 5, 8.0, 4.0)
    row = DG.error_by_daytype(forecasts(spark, y, q), spec_hourly(49)).first()
    assert row["weekend_penalty"] == pytest.approx(2.0) and row["holiday_mae"] is None and row["n_weekend"] == 96


def test_copying_verdicts(spark):
    y = diag()
    lag1 = np.concatenate([[y[0]], y[:-1]])
    rows = {}
    rng = np.random.default_rng(0)
    for name, p in (("copy", lag1), ("perfect", y), ("free", y + rng.normal(0, 60, len(y)))):
        rows[name] = DG.copying_report(forecasts(spark, y, p, lag1, model=name)).first()
    assert rows["copy"]["verdict"] == "collapsed" and rows["copy"]["copy_ratio"] == 0.0 and rows["copy"]["peak_lag"] == 1
    assert rows["perfect"]["peak_lag"] == 0 and rows["perfect"]["peak_correlation"] == pytest.approx(1.0)
    assert rows["perfect"]["copy_ratio"] == pytest.approx(np.abs(y - lag1).mean() / np.abs(np.diff(y)).mean())
    assert rows["free"]["verdict"] == "independent"
    still = DG.copying_report(forecasts(spark, np.ones(50), np.ones(50))).first()
    assert (still["verdict"], still["peak_lag"], still["copy_ratio"]) == ("independent", 0, None)
    inside = DG.lag1_copy_ratio(forecasts(spark, y, y, lag1)).first()["lag1_copy_ratio"]
    assert inside == pytest.approx(1.0)


def test_residual_acf_of_a_copy_and_of_a_perfect_forecast(spark):
    y = diag()
    rows = {r["lag"]: r for r in DG.residual_acf(forecasts(spark, y, y + np.sin(2 * np.pi * np.arange(len(y)) / 24)), 48).collect()}
    assert rows[0]["acf"] == pytest.approx(1.0) and rows[24]["acf"] > 0.9
    assert rows[3]["confidence"] == pytest.approx(1.96 / np.sqrt(len(y)))
    assert all(r["acf"] is None and r["confidence"] == 0 for r in DG.residual_acf(forecasts(spark, y, y), 4).collect())
    assert DG.residual_acf(forecasts(spark, y[:10], y[:10] + np.arange(10.0)), 48).count() == 10


def test_worst_windows_do_not_overlap(spark):
    y = diag()
    p = y.copy()
    p[100:106] += 50
    p[200:206] += 30
    rows = DG.worst_windows(forecasts(spark, y, p), 6).orderBy("place").toPandas()
    assert list(rows["start_index"][:2]) == [100, 200]
    starts = sorted(rows["start_index"])
    assert all(b - a >= 6 for a, b in zip(starts, starts[1:]))
    assert rows["mae"].iloc[0] == pytest.approx(50.0)
    assert str(rows["stop"].iloc[0]) == str(pd.date_range("2013-12-16", periods=400, freq="h")[105])
    assert DG.worst_windows(forecasts(spark, y[:4], y[:4]), 6).count() == 0
    both = DG.worst_windows(forecasts(spark, y, p).unionAll(forecasts(spark, y, p, model="persistence")), 6)
    assert {r["model"] for r in DG.worst_windows_report(both).collect()} == {"m"}


def brute_windows(err, w, top):
    means = [round(err[i : i + w].mean(), 9) for i in range(len(err) - w + 1)]
    chosen = []
    for s in sorted(range(len(means)), key=lambda i: (-means[i], i)):
        if len(chosen) < top and all(abs(s - c) >= w for c in chosen):
            chosen.append(s)
    return chosen


def test_worst_windows_equal_the_greedy_choice(spark):
    rng = np.random.default_rng(9)
    y = diag(150)
    p = y + rng.integers(0, 4, 150)
    rows = DG.worst_windows(forecasts(spark, y, p), 5, top=4).orderBy("place").toPandas()
    assert list(rows["start_index"]) == brute_windows(np.abs(p - y), 5, 4)


def test_fitted_models_beat_the_baselines_on_a_cyclic_series(spark, world):
    spec, _, labelled = world
    scale = M.mase_scale(labelled, spec)
    base = {}
    for r in M.metric_table(FC.baseline_predictions(labelled, spec), scale, spec).filter("split = 'test'").collect():
        base[r["area"]] = min(base.get(r["area"], 9e9), r["mae"])
    harmonic = MO.Harmonic(spec, k_daily=3, k_weekly=2, ar=2)
    fitted = harmonic.fit(labelled)
    rows = M.metric_table(FC.walk_forward(harmonic, labelled, spec, "test", fitted), scale, spec).collect()
    assert len(rows) == 2 and all(r["mae"] < base[r["area"]] for r in rows)
    assert all(r["n"] == 168 for r in rows)
    ic = FC.information_criteria(fitted).collect()
    assert all(r["aicc"] > r["aic"] and r["k"] == 1 + 10 + 2 + 1 for r in ic)
    window = MO.WindowRegression(spec, length=24)
    model = window.fit(labelled)
    mae = {r["area"]: r["mae"] for r in M.metric_table(FC.walk_forward(window, labelled, spec, "test", model), scale, spec).collect()}
    assert all(mae[a] < base[a] for a in base)
    assert window.complexity(spark, model).first()["n_params"] == 24 + 6 + 1


def test_harmonic_coefficients_equal_least_squares(spark, world):
    spec, series, labelled = world
    fit = {r["area"]: r for r in MO.Harmonic(spec, 2, 1, 2).fit(labelled).collect()}
    y = np.log1p(series[1][: 28 * 24])
    x = MO._angles(np.arange(len(y)), {24: 2, 168: 1})
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    z = np.column_stack([e[1:-1], e[:-2]])
    phi, *_ = np.linalg.lstsq(z, e[2:], rcond=None)
    np.testing.assert_allclose(fit[1]["beta"], beta, atol=1e-8)
    np.testing.assert_allclose(fit[1]["phi"], phi, atol=1e-6)
    assert fit[1]["rss"] == pytest.approx(((e[2:] - z @ phi) ** 2).sum(), rel=1e-6)
    assert fit[1]["n"] == len(y) - 2


def test_boosted_trees_with_early_stopping(spark, world):
    spec, _, labelled = world
    trees = MO.BoostedTrees(spec, trees=6, depth=4, step=0.5)
    model = trees.fit(labelled)
    rows = FC.walk_forward(trees, labelled, spec, "test", model)
    assert rows.count() == 2 * 168 and rows.filter("predicted < 0").count() == 0
    top = trees.importance(spark, model, 3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"]
    size = trees.complexity(spark, model).first()
    assert 1 <= size["n_trees"] <= 6 and size["n_leaves"] == (size["n_nodes"] + size["n_trees"]) // 2


def test_tuning_orders_candidates_and_final_fit_scores(spark, world):
    spec, _, labelled = world
    grid = [("flat", MO.Harmonic(spec, 0, 0, 0)), ("cyclic", MO.Harmonic(spec, 2, 2, 1))]
    rows = MO.tune_grid(grid, labelled, spec).collect()
    assert [r["candidate"] for r in rows] == ["cyclic", "flat"]
    assert MO.final_scores(grid[1][1], labelled, spec).count() == 2


def test_key_figures(spark):
    scores = spark.createDataFrame(
        [(1, "persistence", 1.0), (2, "persistence", 2.0), (1, "seasonal_naive", 3.0), (2, "seasonal_naive", 3.0), (1, "a", 0.5), (2, "a", 2.5), (1, "b", 1.5), (2, "b", 2.5)],
        "area long, model string, mase double",
    )
    row = K.fact_models(scores).first()
    assert (row["best_model"], row["best_mase"], row["models_beating_persistence"]) == ("a", 1.5, 0)
    assert row["gain_over_persistence_pct"] == pytest.approx(0.0)
    assert {r["model"]: r["worst_ratio"] for r in K.fact_stress_ratio(scores).collect()} == {"a": 1.25, "b": 1.5}
    assert K.fact_persistence_wins(scores).first()[0] == 1
    table = {r["model"]: r for r in DG.cross_area_mase(scores, (1, 9)).collect()}
    assert table["a"]["mase_1"] == 0.5 and table["a"]["mase_9"] is None and table["a"]["n_areas"] == 2
    log = spark.createDataFrame(
        [("a", 1, "s1", 0, 3.0, 1), ("a", 1, "s1", 1, float("nan"), 1), ("a", 1, "s2", 0, 2.0, 2), ("a", 1, "s2", 1, 2.5, 2), ("b", 1, "s1", 0, None, 1)],
        "model string, area long, stage string, seed int, valid_mae double, stage_order int",
    )
    best = K.log_best(log).collect()
    assert [(r["model"], r["stage"], r["valid_mae"]) for r in best] == [("a", "s2", 2.0)]
    assert sorted((r["model"] or "", r["stage"] or "", r["n"]) for r in K.log_summary(log).collect()) == [("", "", 5), ("", "s1", 3), ("", "s2", 2), ("a", "", 4), ("b", "", 1)]
    spread = {r["stage"]: r for r in K.sweep_spread(log.filter("model = 'a' AND NOT isnan(valid_mae)")).collect()}
    assert spread["s2"]["spread"] == pytest.approx(0.25) and spread["s2"]["gain"] == pytest.approx(1.0)


def test_fitted_forecasts_reach_metrics_diagnostics_and_ensembles(spark, world):
    spec, _, labelled = world
    trees = [MO.BoostedTrees(spec, trees=4, depth=3, step=0.5, seed=s) for s in spec.seeds[:2]]
    table = MO.final_predictions([MO.Harmonic(spec, 2, 1, 1), *trees], labelled, spec, ("test",))
    steps = 7 * spec.daily
    counts = {(r["model"], r["seed"]): r["count"] for r in table.groupBy("model", "seed").count().collect()}
    assert counts == {(m, s): 2 * steps for m, s in (("persistence", 0), ("seasonal_naive", 0), ("harmonic", 0), ("boosted_trees", 0), ("boosted_trees", 1))}
    both = table.unionByName(FC.seed_ensemble(table, "boosted_trees").drop("n_members"))
    scores = M.ranked(M.metric_table(both, M.mase_scale(labelled, spec), spec)).collect()
    assert len(scores) == 2 * 6 and [r["mase"] for r in scores[:6]] == sorted(r["mase"] for r in scores[:6])
    mae = {(r["area"], r["model"], r["seed"]): r["mae"] for r in scores}
    assert all(mae[a, "boosted_trees_ensemble", 0] <= max(mae[a, "boosted_trees", s] for s in (0, 1)) + 1e-9 for a in (1, 2))
    assert {r["model"] for r in DG.copying_report(both).collect()} >= {"harmonic", "boosted_trees"}
    assert {r["model"] for r in DG.worst_windows(both.filter("seed = 0"), 24).collect()} >= {"harmonic", "boosted_trees"}


def test_grid_fits_equal_single_fits(world):
    """Each candidate from the shared products is the model that a fit of its own gives, up to the few rows without enough predecessors."""
    spec, _, labelled = world
    grid = {(r["area"], r["k_daily"], r["k_weekly"], r["ar"]): r for r in MO.harmonic_grid(labelled, spec, (1, 3), (1, 2), (1, 3)).collect()}
    assert len({k[1:] for k in grid}) == 8
    for d, w, p in ((1, 2, 3), (3, 1, 3), (3, 2, 1)):
        for r in MO.Harmonic(spec, d, w, p).fit(labelled).collect():
            got = grid[r["area"], d, w, p]
            assert got["k"] == r["k"] and np.allclose(got["beta"], r["beta"], atol=1e-9)
            assert np.allclose(got["phi"], r["phi"], atol=1e-9 if p == 3 else 0.02)


def test_tuning_the_harmonic_model_scores_what_its_own_forecasts_score(world):
    spec, _, labelled = world
    winner, table = MO.tune_harmonic(labelled, spec, (1, 2), (1,), (1, 2))
    rows = table.collect()
    assert [r["stage"] for r in rows].count("fourier_order") == 2 and sum(r["selected"] for r in rows) == 2
    orders = {r["candidate"]: r for r in rows if r["stage"] == "ar_order"}
    assert orders[f"ar={winner.ar}"]["valid_mae"] == min(r["valid_mae"] for r in orders.values())
    best = next(r for r in rows if r["stage"] == "fourier_order" and r["selected"])
    assert best["candidate"] == f"k_daily={winner.k_daily} k_weekly={winner.k_weekly}"
    twin = MO.Harmonic(spec, winner.k_daily, winner.k_weekly, 2)
    alone = MO.tune_grid([("x", twin)], labelled, spec).first()
    assert orders["ar=2"]["valid_mae"] == pytest.approx(alone["valid_mae"], rel=1e-6) and orders["ar=2"]["n"] == alone["n"]


def test_stages_carry_the_winner_forward(world):
    spec, _, labelled = world
    stages = [("sequence_length", [{"length": 2}, {"length": 24}]), ("calendar_ablation", [{"calendar": True}, {"calendar": False}])]
    winner, table = MO.tune_stages(MO.WindowRegression(spec), stages, labelled, spec)
    rows = table.collect()
    assert [r["stage"] for r in rows] == ["sequence_length"] * 2 + ["calendar_ablation"] * 2
    chosen = {r["stage"]: r["candidate"] for r in rows if r["selected"]}
    assert chosen == {"sequence_length": f"length={winner.length}", "calendar_ablation": f"calendar={winner.calendar}"}


def test_the_final_fit_keeps_the_trees_that_validation_chose(world):
    spec, _, labelled = world
    trees = MO.BoostedTrees(spec, trees=6, depth=3, step=0.5)
    final = MO.settled(trees, labelled)
    assert final.trees == trees.fit(labelled).model.getNumTrees and not final.early_stop and final.fit_on == MO.REFIT
    table = MO.tune_grid([("k=1", MO.Harmonic(spec, 1, 0, 0)), ("k=2", MO.Harmonic(spec, 2, 1, 1))], labelled, spec)
    assert MO.best_candidate(table) == "k=2" and MO.log_rows(table, "next").count() == 2


def test_window_models_are_tuned_from_a_few_passes(spark, world):
    """All candidates share one pass over train, and those of a stage one over validation; a NULL costs what it costs the fit row by row."""
    spec, _, labelled = world
    lost = (F.col("area") == 2) & F.col("t_index").between(100, 103)
    labelled = labelled.withColumn("value", F.when(~lost, F.col("value")))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    stages = [("sequence_length", [{"length": n} for n in (5, 24, 30)]), ("regularisation", [{"reg": r, "mix": m} for r in (0.001, 0.1) for m in (0.0, 0.5)]), ("calendar", [{"calendar": True}, {"calendar": False}])]
    winner, table = MO.tune_windows(MO.WindowRegression(spec), stages, labelled.mapInArrow(counted, labelled.schema), spec)
    assert seen.value <= 5 * labelled.count()
    plain, beside = MO.tune_stages(MO.WindowRegression(spec), stages, labelled, spec)
    assert winner == plain
    for a, b in zip(table.collect(), beside.collect(), strict=True):
        assert a["candidate"] == b["candidate"] and a["n"] == b["n"] and a["n_without_forecast"] == b["n_without_forecast"] and a["selected"] == b["selected"]
        assert a["valid_mae"] == pytest.approx(b["valid_mae"], rel=1e-9) and a["valid_rmse"] == pytest.approx(b["valid_rmse"], rel=1e-9)


def test_window_fit_equals_the_learner_on_all_rows(world):
    spec, _, labelled = world
    model = MO.WindowRegression(spec, length=24, reg=0.01)
    found = model.fit(labelled)
    rows = model.design(labelled, found.stats).filter("split = 'train' and complete").select("features", F.col("scaled").alias("label"))
    direct = LinearRegression(regParam=0.01, elasticNetParam=0.5, solver="auto").fit(rows)
    np.testing.assert_allclose(found.model.coefficients, direct.coefficients.toArray(), atol=1e-8)
    assert found.model.intercept == pytest.approx(direct.intercept, abs=1e-8)


def test_trees_share_their_rows(spark, world):
    """Candidates on the same features are fitted from one stored table and scored in one pass, as each would be alone."""
    spec, _, labelled = world
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    grid = [("a", MO.BoostedTrees(spec, trees=2, depth=1)), ("b", MO.BoostedTrees(spec, trees=2, depth=2))]
    got = MO.tree_scores(grid, labelled.mapInArrow(counted, labelled.schema), spec).collect()
    assert seen.value <= 3 * labelled.count()
    alone = {label: MO.tune_grid([(label, m)], labelled, spec, "trees").first() for label, m in grid[1:]}
    for r in got:
        if r["candidate"] in alone:
            want = alone[r["candidate"]]
            assert r["n"] == want["n"] and r["n_without_forecast"] == want["n_without_forecast"]
            assert r["valid_mae"] == pytest.approx(want["valid_mae"], rel=0.05)
