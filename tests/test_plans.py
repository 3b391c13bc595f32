import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellpulse.plans.dims import literal_table
from cellpulse.plans.ordering import globally_ordered, quantile_of_ordered
from cellpulse.plans.series import ordinal, over_series, running_total
from cellpulse.plans.storage import shared_dir
from tests.fixtures import spec_hourly


def frame(spark, n=500, areas=2, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {"area": np.repeat(np.arange(areas), n), "t_index": np.tile(np.arange(n), areas), "value": rng.normal(size=n * areas)}
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("chunk", [16, 37, 8192])
def test_chunked_windows_equal_whole_series(spark, chunk):
    pdf, df = frame(spark)

    def build(w):
        return {
            "lagged": F.lag("value", 7).over(w),
            "ahead": F.lead("value", 3).over(w),
            "mean": F.avg("value").over(w.rowsBetween(-5, 2)),
        }

    got = over_series(df, build, before=7, after=3, chunk=chunk).toPandas().sort_values(["area", "t_index"]).reset_index(drop=True)
    assert len(got) == len(pdf)
    for _, part in got.groupby("area"):
        v = part["value"]
        np.testing.assert_allclose(part["lagged"], v.shift(7))
        np.testing.assert_allclose(part["ahead"], v.shift(-3))
        want = [v.iloc[max(0, i - 5) : i + 3].mean() for i in range(len(v))]
        np.testing.assert_allclose(part["mean"], want)


@pytest.mark.parametrize("chunk", [10, 8192])
def test_running_total_over_chunks(spark, chunk):
    pdf, df = frame(spark, n=95)
    got = running_total(df, "value", "s", chunk=chunk).toPandas().sort_values(["area", "t_index"])
    np.testing.assert_allclose(got["s"], pdf.groupby("area")["value"].cumsum())


def test_ordinal_positions(spark):
    t = [3, 4, 9, 27, 28, 29, 100]
    df = spark.createDataFrame([(x,) for x in t], "t_index long")
    got = {r["t_index"]: r["pos"] for r in ordinal(df, "t_index", "pos", chunk=8).collect()}
    assert got == {x: i + 1 for i, x in enumerate(t)}


@pytest.mark.parametrize("descending", [False, True])
def test_global_order_with_a_value_holding_a_third_of_all_rows(spark, descending):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.zeros(400), rng.integers(0, 50, 300), rng.lognormal(size=500)])
    pdf = pd.DataFrame({"area": rng.permutation(len(v)), "total": v})
    got = globally_ordered(spark.createDataFrame(pdf), "total", "area", descending=descending, ties=True).toPandas()
    want = pdf.assign(k=-pdf.total if descending else pdf.total).sort_values(["k", "area"]).reset_index(drop=True)
    want["position"] = want.index + 1
    want["rank"] = want["k"].rank(method="min").astype(int)
    got = got.sort_values("position").reset_index(drop=True)
    assert (got["area"] == want["area"]).all()
    assert (got["rank"] == want["rank"]).all()
    np.testing.assert_allclose(got["running"], want["total"].cumsum())
    assert set(got["n_rows"]) == {len(v)}


def test_quantiles_of_an_ordered_table(spark):
    rng = np.random.default_rng(4)
    v = rng.lognormal(size=333)
    ordered = globally_ordered(spark.createDataFrame(pd.DataFrame({"area": np.arange(333), "total": v})), "total", "area")
    row = ordered.agg(quantile_of_ordered("total", 0.5).alias("m"), quantile_of_ordered("total", 0.01).alias("p")).first()
    assert row["m"] == pytest.approx(np.median(v))
    assert row["p"] == pytest.approx(np.percentile(v, 1))


def test_ordering_an_empty_and_a_single_row_table(spark):
    empty = spark.createDataFrame([], "area long, total double")
    assert globally_ordered(empty, "total", "area", ties=True).count() == 0
    one = spark.createDataFrame([(5, 2.0)], "area long, total double")
    row = globally_ordered(one, "total", "area", ties=True).first()
    assert (row["position"], row["rank"], row["running"]) == (1, 1, 2.0)


def test_literal_table_needs_no_scan_and_has_a_limit(spark):
    df = literal_table(spark, [(1, "x")], ("a", "b"), ("int", "string"))
    assert df.collect()[0].asDict() == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        literal_table(spark, [(i,) for i in range(3000)], ("a",), ("int",))


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_nothing_moves_the_grid(spark):
    from cellpulse.operators import panel as P
    from cellpulse.operators.series import difference

    spec = spec_hourly(10, n_areas=3)
    rollup = spark.createDataFrame([(1, 5, 2.0, 1)], "area long, t_index long, value double, n_rows long")
    full, stacked = P.full_panel(rollup, spec), P.stack_days(P.densify(rollup, spec), spec)
    # the occupied cells, the marks of areas and chunks, and the steps seen; none lies above the generator of the grid
    for df in (full, stacked, difference(full, 24), full.groupBy("area").agg({"value": "sum"})):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        made = next(i for i, line in enumerate(lines) if "Generate explode(CASE WHEN NOT _mark" in line)
        assert not [line for line in lines[:made] if "Exchange" in line]
    assert len(exchanges(full)) == 1


@pytest.mark.parametrize("days", [2, 400])
def test_cells_filled_in_place_equal_a_plain_grid(spark, monkeypatch, days):
    from cellpulse.operators import panel as P

    if days == 400:  # several chunks, and areas dealt by chunk
        monkeypatch.setattr(P, "CHUNK_STEPS", 1_000)
        monkeypatch.setattr(P, "PLACED_STEPS", 5_000)
    spec = spec_hourly(days, n_areas=3)
    rng = np.random.default_rng(days)
    occupied = {(int(a), int(t)): float(rng.integers(1, 9)) for a, t in zip(rng.integers(1, 3, 60), rng.integers(0, spec.n_steps, 60))}
    occupied[(1, 0)], occupied[(2, spec.n_steps - 1)] = 4.0, 5.0
    rollup = spark.createDataFrame([(a, t, v, 1) for (a, t), v in occupied.items()], "area long, t_index long, value double, n_rows long")
    seen = {t for _, t in occupied}
    cells = lambda df: sorted((r["area"], r["t_index"], r["value"]) for r in df.collect())
    every = [(a, t) for a in (1, 2, 3) for t in range(spec.n_steps)]
    assert cells(P.full_panel(rollup, spec)) == [(a, t, occupied.get((a, t), 0.0)) for a, t in every]
    dense = P.densify(rollup, spec)
    assert cells(dense) == [(a, t, occupied.get((a, t), 0.0)) for a, t in every if t in seen]
    placed = sorted(P.stack_days(dense, spec).collect(), key=lambda r: (r["area"], r["t_index"]))
    assert [(r["area"], r["t_index"], r["value"]) for r in placed] == [(a, t, occupied.get((a, t), 0.0) if t in seen else None) for a, t in every]


def test_a_cell_given_twice_stays_twice_and_an_empty_roll_up_is_silent(spark):
    from cellpulse.operators import panel as P

    spec = spec_hourly(1, n_areas=2)
    schema = "area long, t_index long, value double, n_rows long"
    twice = spark.createDataFrame([(1, 3, 1.0, 1), (1, 3, 2.0, 1)], schema)
    assert P.full_panel(twice, spec).count() == 49 and P.full_panel(twice, spec).agg({"value": "sum"}).first()[0] == 3.0
    empty = spark.createDataFrame([], schema)
    assert P.full_panel(empty, spec).count() == 48 and P.densify(empty, spec).count() == 0
    assert P.stack_days(P.densify(empty, spec), spec).filter("value is null").count() == 48
