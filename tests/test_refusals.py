"""Nothing is lost in silence: gaps keep their place, rows that do not belong fail the query, work is spread and pruned."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellpulse.operators import distribution as D
from cellpulse.operators import features as FE
from cellpulse.operators import forecast as FC
from cellpulse.operators import models as MO
from cellpulse.operators import panel as P
from cellpulse.operators import quality as Q
from cellpulse.operators import series as S
from cellpulse.operators import stationarity as ST
from cellpulse.plans import storage
from cellpulse.sources import readers as R
from cellpulse.sources import writers as WR
from tests.fixtures import panel_frame, spec_hourly

SPLITS = (("train", 8), ("validation", 2), ("test", 2))


@pytest.fixture(scope="module")
def gapped(spark):
    """Two cyclic areas; the second lacks ten steps in train and three in test."""
    spec = spec_hourly(12, n_areas=2, splits=SPLITS, lags=(1, 24), rolling=(3,))
    t = np.arange(12 * 24)
    series = {a: 1000.0 + 10 * a + t + 50 * np.sin(t / 24 * 2 * np.pi) for a in (1, 2)}
    series[2][60:70] = np.nan
    series[2][260:263] = np.nan
    return FE.assign_split(panel_frame(spark, series, spec), spec), spec, series


def test_lags_keep_their_distance_over_a_gap(gapped):
    labelled, spec, series = gapped
    stats = FE.scaler_fit(labelled.filter("split = 'train'"))
    design = MO.BoostedTrees(spec).design(labelled, stats)
    logged = np.log1p(series[2])
    mean, std = np.nanmean(logged[: 8 * 24]), np.nanstd(logged[: 8 * 24])
    rows = {r.t_index: r for r in design.filter("area = 2").collect()}
    assert len(rows) == 12 * 24 - 24
    for t in (84, 89, 93, 94, 150):
        want = (logged[t - 24] - mean) / std
        assert rows[t].complete == (not np.isnan(want)) and (np.isnan(want) or rows[t].lag_24 == pytest.approx(want))
    window = MO.WindowRegression(spec, length=5).design(labelled, stats)
    assert {r.t_index for r in window.filter("area = 2 and not complete").collect()} == {*range(5), *range(61, 75), *range(261, 268)}


def test_every_model_has_every_row_of_a_split(gapped):
    labelled, spec, _ = gapped
    models = [FC.persistence(), FC.seasonal_naive(spec), MO.Harmonic(spec, k_daily=1, k_weekly=0, ar=1), MO.BoostedTrees(spec, trees=3, depth=2, seed=7), MO.WindowRegression(spec, length=5)]
    for m in models:
        rows = FC.walk_forward(m, labelled, spec, "test", m.fit(labelled)).collect()
        assert len(rows) == 2 * 48 and {r.seed for r in rows} == {getattr(m, "seed", 0)}
        for r in rows:
            at = r.t_index
            whole = r.area == 1 or not (m.reach >= at - 262 > 0 or at in (261, 262))
            assert not whole or r.predicted is not None, (m.name, at)
            assert (r.area, at) not in {(2, 261), (2, 262), (2, 263)} or r.predicted is None or m.name == "seasonal_naive", (m.name, at)
            if r.area == 1:
                assert r.persistence == pytest.approx(1010.0 + at - 1 + 50 * np.sin((at - 1) / 24 * 2 * np.pi))


def test_what_cannot_be_scaled_fails(spark):
    spec = spec_hourly(12, n_areas=1, splits=SPLITS)
    for values, told in ((np.full(288, 5.0), "constant"), (np.r_[-1.0, np.arange(287.0)], "negative")):
        labelled = FE.assign_split(panel_frame(spark, {1: values}, spec), spec)
        with pytest.raises(Exception, match=told):
            FE.scaler_fit(labelled.filter("split = 'train'")).collect()
    two = FE.assign_split(panel_frame(spark, {1: np.arange(288.0), 2: np.arange(288.0)}, spec), spec)
    with pytest.raises(Exception, match="no scaling statistics"):
        FE.scaler_transform(two, FE.scaler_fit(two.filter("area = 1"))).collect()


@pytest.mark.parametrize(("area", "step"), [(3, 0), (0, 0), (1, 48), (1, -1)])
def test_rows_outside_the_grid_fail(spark, area, step):
    spec = spec_hourly(2, n_areas=2)
    rollup = spark.createDataFrame([(1, 0, 1.0, 1), (area, step, 10.0, 1)], "area long, t_index long, value double, n_rows long")
    with pytest.raises(Exception, match="outside the panel"):
        P.full_panel(rollup, spec).agg(F.sum("value")).collect()
    with pytest.raises(Exception, match="outside the panel"):
        P.stack_days(rollup, spec).agg(F.sum("value")).collect()


def test_negative_totals_have_no_concentration(spark):
    totals = spark.createDataFrame([(1, -5.0), (2, 3.0), (3, 4.0)], "area long, total double")
    ordered = D.globally_ordered(totals, "total", "area")
    for bad in (D.gini(ordered), D.top_share(ordered), D.bottom_half_share(ordered), D.distribution_stats(totals)):
        with pytest.raises(Exception, match="negative"):
            bad.collect()


def test_only_steps_missing_everywhere_are_filled(spark):
    spec = spec_hourly(2, n_areas=2)
    series = {a: np.arange(48.0) * a for a in (1, 2)}
    for a in (1, 2):
        series[a][[10, 11, 30]] = np.nan
    series[2][[5, 29]] = np.nan
    rows = {(r.area, r.t_index): r for r in P.interpolate_gaps(panel_frame(spark, series, spec), spec).collect()}
    assert {k for k, r in rows.items() if r.filled} == {(1, 10), (1, 11), (2, 10), (2, 11), (1, 30)}
    assert rows[2, 5].value is None and rows[2, 29].value is None and rows[2, 30].value is None
    assert rows[2, 11].value == pytest.approx(22.0)


@pytest.mark.parametrize("areas", [1_500, 10_000])
def test_the_grid_is_spread_over_all_tasks(spark, areas):
    spec = spec_hourly(30, n_areas=areas)
    from cellpulse.plans.series import whole_numbers

    steps = spark.range(spec.n_steps).select(F.col("id").alias("t_index"), F.lit(1).cast("long").alias("lo"), F.lit(areas).cast("long").alias("hi"))
    grid = whole_numbers(steps, "lo", "hi", "area")
    sizes = [r[1] for r in grid.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == areas * spec.n_steps and len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8


def test_log_appends_of_different_columns_read_as_one(spark, tmp_path):
    path = str(tmp_path / "log")
    WR.append_log(spark.createDataFrame([("gbt", "why", 1)], "model string, rationale_for_next_change string, seed int"), path)
    WR.append_log(spark.createDataFrame([("gbt", "why", 0.5, 3)], "model string, rationale_for_next_change string, train_mae double, area int"), path)
    rows = spark.read.parquet(path).select("seed", "train_mae", "area").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, None, None), (None, 0.5, 3)]
    with pytest.raises(Q.PanelError, match="oops"):
        WR.append_log(spark.createDataFrame([("gbt", "why", 1)], "model string, rationale_for_next_change string, oops int"), path)


def test_a_gap_adds_no_power(spark):
    spec = spec_hourly(10, n_areas=1)
    x = np.full(240, 100.0)
    x[50:60] = np.nan
    power = [r.power for r in S.periodogram(panel_frame(spark, {1: x}, spec), spec).collect()]
    assert len(power) == 120 and max(power) < 1e-18


def test_a_spectrum_of_many_chunks_stays_linear(spark):
    spec = spec_hourly(50, n_areas=2)
    rng = np.random.default_rng(0)
    series = {a: rng.standard_normal(1_200) for a in (1, 2)}
    frame = panel_frame(spark, series, spec)
    rows = {(r.area, r.k): r.power for r in S.periodogram(frame, spec, chunk=24).collect()}
    assert len(rows) == 2 * 600
    for a, x in series.items():
        f = np.abs(np.fft.rfft(x - x.mean())[1:]) ** 2 * 2 / 1_200
        f[-1] /= 2
        assert [rows[a, k] for k in range(1, 601)] == pytest.approx(list(f))


def test_adf_order_follows_the_length_of_each_series(spark):
    spec = spec_hourly(40, n_areas=2)
    rng = np.random.default_rng(3)
    walk = rng.standard_normal(960).cumsum()
    short = np.full(960, np.nan)
    short[:60] = walk[:60]
    both = {r.area: r for r in ST.adf(panel_frame(spark, {1: walk, 2: short}, spec), spec).collect()}
    alone = ST.adf(panel_frame(spark, {2: short}, spec), spec, max_lag=ST.adf_max_lag(60)).first()
    assert (both[2].adf_lags, both[2].adf_nobs) == (alone.adf_lags, alone.adf_nobs) and both[2].adf_stat == pytest.approx(alone.adf_stat)


def test_dates_prune_the_stored_panel(spark, tmp_path):
    spec = spec_hourly(12, n_areas=2, splits=SPLITS)
    path = str(tmp_path / "panel")
    WR.sink_panel(panel_frame(spark, {a: np.arange(288.0) for a in (1, 2)}, spec), path)
    stored = R.scan_panel(spark, path)
    days = P.date_window(stored, spec.start + dt.timedelta(days=3), 2)
    reach = FC.with_reach(FE.assign_split(stored, spec), spec, ["test"], 24)
    for frame, rows in ((days, 96), (reach, None)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date" in plan, plan
        assert rows is None or frame.count() == rows


def test_stages_need_a_shared_folder_and_can_be_deleted(spark):
    for master in ("local-cluster[2,1,512]", "yarn", "spark://host:7077"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(RuntimeError, match="checkpoint"):
            storage.shared_dir(session)
    kept = storage.durable(spark.range(5))
    assert kept.count() == 5 and storage.discard_stages(spark) >= 1 and storage.discard_stages(spark) == 0
