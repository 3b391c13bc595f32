import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators import features as FE
from cellpulse.operators.panel import with_times
from cellpulse.operators.quality import PanelError
from tests.fixtures import panel_frame, spec_hourly

SPLITS = (("train", 12), ("validation", 3), ("test", 3), ("stress", 3))


@pytest.fixture(scope="module")
def world(spark):
    spec = spec_hourly(21, n_areas=2, splits=SPLITS)
    rng = np.random.default_rng(0)
    t = np.arange(21 * 24)
    series = {1: 100 + 40 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 3, len(t)), 2: rng.gamma(2, 5, len(t))}
    return spec, series, FE.assign_split(panel_frame(spark, series, spec), spec)


def test_splits_tile_the_period(world):
    spec, _, labelled = world
    rows = {r["split"]: r for r in FE.check_splits(labelled, spec).collect()}
    assert {k: r["n_steps"] for k, r in rows.items()} == {"train": 288, "validation": 72, "test": 72, "stress": 72}
    assert all(r["complete"] and r["contiguous"] for r in rows.values())
    short = labelled.filter("t_index <> 100")
    bad = {r["split"]: r["complete"] for r in FE.check_splits(short, spec).collect()}
    assert bad["train"] is False


def test_final_fit_never_sees_the_test_split(world):
    _, _, labelled = world
    assert {r[0] for r in FE.fit_rows(labelled).select("split").distinct().collect()} == {"train", "validation"}
    with pytest.raises(PanelError):
        FE.fit_rows(labelled, ("train", "test"))


def test_scaler_round_trip_and_refusals(spark, world):
    _, series, labelled = world
    train = labelled.filter("split = 'train'")
    stats = FE.scaler_fit(train)
    row = stats.filter("area = 2").first()
    logs = np.log1p(series[2][:288])
    assert (row["log_mean"], row["log_std"]) == (pytest.approx(logs.mean()), pytest.approx(logs.std()))
    back = FE.scaler_inverse(FE.scaler_transform(labelled, stats).drop("value"), stats).filter("area = 2").orderBy("t_index").toPandas()
    np.testing.assert_allclose(back["value"], series[2])
    low = FE.scaler_inverse(labelled.withColumn("scaled", F.lit(-1e3)).drop("value"), stats)
    assert low.agg(F.max("value")).first()[0] == 0.0
    bad = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, -1.0), (2, 1.0), (3, None), (4, 1.0), (4, 2.0)], "area long, value double")
    assert {r["area"]: r["reason"] for r in FE.scaler_violations(bad).collect()} == {1: "constant", 2: "negative", 3: "empty"}


def test_features_equal_a_direct_computation(world):
    spec, series, labelled = world
    design = FE.design_matrix(labelled, spec).filter("area = 1").orderBy("t_index").toPandas()
    x = series[1]
    assert list(design["t_index"]) == list(range(168, len(x)))
    for row in design.iloc[::37].itertuples():
        t = row.t_index
        assert row.lag_1 == x[t - 1] and row.lag_168 == x[t - 168]
        assert row.roll_mean_24 == pytest.approx(x[t - 24 : t].mean())
        assert row.roll_std_3 == pytest.approx(x[t - 3 : t].std())
    assert design["is_weekend"].iloc[0] == 0.0
    assert FE.feature_names(spec)[:4] == ["lag_1", "lag_2", "lag_24", "lag_168"]
    vectors = FE.assembled(FE.design_matrix(labelled, spec), FE.feature_names(spec))
    assert vectors.first()["features"].size == len(FE.feature_names(spec))
    with pytest.raises(PanelError):
        FE.design_matrix(labelled, spec_hourly(7))


def test_changing_the_future_moves_no_feature(world):
    spec, _, labelled = world
    panel = labelled.select("area", "t_index", "local", "value")
    assert FE.causality_audit(panel, spec, cut=300).count() == 0
    # the audit does notice a feature that looks ahead
    from cellpulse.plans.series import over_series

    leak = over_series(panel, lambda w: {"x": F.lead("value", 1).over(w)}, after=1).filter("t_index <= 300").select("area", "t_index", "x")
    moved = panel.withColumn("value", F.when(F.col("t_index") >= 300, -1.0).otherwise(F.col("value")))
    leak2 = over_series(moved, lambda w: {"x": F.lead("value", 1).over(w)}, after=1).filter("t_index <= 300").select("area", "t_index", "x")
    assert leak.exceptAll(leak2).count() > 0


def test_windows_hold_only_the_past(world):
    spec, series, labelled = world
    for horizon in (1, 3):
        rows = FE.sliding_windows(labelled, 5, horizon).filter("area = 1").orderBy("t_index").toPandas()
        assert len(rows) == len(series[1]) - 5 - horizon + 1
        t = rows["t_index"].iloc[40]
        np.testing.assert_array_equal(rows["window"].iloc[40], series[1][t - 5 - horizon + 1 : t - horizon + 1])
    exog = FE.window_exog(FE.calendar_features(FE.sliding_windows(labelled, 4), spec), ["is_weekend"]).first()
    assert len(exog["exog"]) == 4
    with pytest.raises(PanelError):
        FE.sliding_windows(labelled, 0)


def test_calendar_is_cyclic_and_knows_holidays(spark):
    spec = spec_hourly(14, n_areas=1, holidays=((dt.date(2013, 11, 6), "x", "national", ""), (dt.date(2013, 11, 7), "y", "observance", "")))
    rows = FE.calendar_features(with_times(spark.range(14 * 24).withColumnRenamed("id", "t_index"), spec), spec).toPandas().sort_values("t_index")
    assert rows["sin_minute_of_day"].iloc[6] == pytest.approx(1.0)
    first, last = rows.iloc[0], rows.iloc[23]
    near = np.hypot(first.sin_minute_of_day - last.sin_minute_of_day, first.cos_minute_of_day - last.cos_minute_of_day)
    assert near == pytest.approx(2 * np.sin(np.pi / 24))
    assert set(rows.groupby(rows.t_index // 24)["is_weekend"].max().iloc[[5, 6]]) == {1.0}
    assert rows["is_holiday"].sum() == 48


def test_fourier_phase_continues_and_order_is_limited(spark):
    rows = FE.fourier_terms(spark.range(1000).withColumnRenamed("id", "t_index"), {24: 2}).toPandas().sort_values("t_index")
    np.testing.assert_allclose(rows["sin_24_2"], np.sin(2 * np.pi * 2 * np.arange(1000) / 24), atol=1e-9)
    with pytest.raises(ValueError):
        X.fourier_columns("t_index", {24: 13})


def test_window_plan_has_one_shuffle(world):
    spec, _, labelled = world
    plan = FE.design_matrix(labelled, spec)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan
