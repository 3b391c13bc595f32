import numpy as np
import pytest

from cellpulse.operators import anomalies as A
from cellpulse.operators import series as S
from cellpulse.operators import stationarity as ST
from cellpulse.operators.quality import PanelError
from tests.fixtures import panel_frame, spec_hourly, two_season


def ordered(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def brute_acf(x, k):
    x = x - x.mean()
    return np.array([x[i:] @ x[: len(x) - i] for i in range(k + 1)]) / (x @ x)


def test_acf_equals_the_definition_whatever_the_chunks(spark):
    spec = spec_hourly(28, n_areas=2)
    series = {1: two_season(28 * 24), 2: np.random.default_rng(5).normal(size=28 * 24)}
    panel = panel_frame(spark, series, spec)
    for chunk in (100, None):
        got = ordered(S.lag_products(panel, 30, chunk=chunk), "area", "lag")
        for area, part in got.groupby("area"):
            np.testing.assert_allclose(part["product"] / part["c0"], brute_acf(series[area], 30), atol=1e-10)
            assert set(part["n"]) == {28 * 24}
    rows = ordered(S.acf(panel, 180), "area", "lag")
    assert rows.loc[(rows.area == 1) & (rows.lag == 24), "acf"].iloc[0] > 0.8
    band = (rows["upper"] - rows["acf"])[(rows.area == 2) & (rows.lag == 1)].iloc[0]
    assert band == pytest.approx(1.959963984540054 / np.sqrt(28 * 24))
    peaks = ordered(S.acf_peaks(S.acf(panel, 180)).filter("area = 1"), "position")
    assert peaks["lag"].iloc[0] in (24, 168)
    assert {24, 168} <= set(peaks["lag"])


def test_constant_series_has_no_autocorrelation(spark):
    spec = spec_hourly(4, n_areas=1)
    rows = S.acf(panel_frame(spark, {1: np.full(96, 3.0)}, spec), 5).collect()
    assert len(rows) == 6 and all(r["acf"] is None for r in rows)


def test_pacf_of_an_autoregression_cuts_off(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=100 * 24)
    x = np.zeros_like(e)
    for t in range(2, len(e)):
        x[t] = 0.5 * x[t - 1] + 0.3 * x[t - 2] + e[t]
    spec = spec_hourly(100, n_areas=1)
    got = ordered(S.pacf(panel_frame(spark, {1: x}, spec), spec, 10), "lag")
    rho = brute_acf(x, 10)
    for k in (1, 2, 5):  # the last coefficient of the Yule-Walker system of order k
        r = rho[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert got["pacf"][k] == pytest.approx(np.linalg.solve(r, rho[1 : k + 1])[-1])
    assert got["pacf"][2] == pytest.approx(0.3, abs=0.06)
    assert abs(got["pacf"][5]) < 0.06


def test_periodogram_over_chunks_equals_one_transform(spark):
    spec = spec_hourly(28, n_areas=1)
    x = two_season(28 * 24)
    n = len(x)
    panel = panel_frame(spark, {1: x}, spec)
    want = np.abs(np.fft.rfft(x - x.mean())) ** 2 / n
    want[1:-1] *= 2
    for chunk in (100, None):
        got = ordered(S.periodogram(panel, spec, chunk=chunk), "k")
        np.testing.assert_allclose(got["power"], want[1:], rtol=1e-6, atol=1e-6)
    peaks = ordered(S.periodogram_peaks(panel, spec, top=2), "position")
    assert [round(h) for h in peaks["period_hours"]] == [24, 168]


def test_components_add_up_and_cycles_are_strong(spark):
    spec = spec_hourly(28, n_areas=1)
    panel = panel_frame(spark, {1: two_season(28 * 24)}, spec).select("area", "t_index", "value")
    out = S.seasonal_decompose(panel, spec, (24, 168))
    pdf = ordered(out, "t_index")
    np.testing.assert_allclose(pdf["trend"] + pdf["seasonal_24"] + pdf["seasonal_168"] + pdf["residual"], pdf["value"])
    strength = {r["component"]: r for r in S.component_strength(out, (24, 168)).collect()}
    assert strength["seasonal_24"]["strength"] > 0.95
    assert strength["seasonal_168"]["strength"] > 0.9
    assert strength["residual"]["strength"] is None and strength["residual"]["variance_share"] < 0.05
    with pytest.raises(PanelError):
        S.seasonal_decompose(panel, spec_hourly(10, n_areas=1), (24, 168))


def test_nested_and_sequential_cycles_agree(spark):
    spec = spec_hourly(21, n_areas=1)
    panel = panel_frame(spark, {1: two_season(21 * 24)}, spec).select("area", "t_index", "value")
    base = panel.withColumn("residual", panel["value"])
    nested = ordered(S._take_nested_cycles(base, [24, 168]), "t_index")
    stepwise = ordered(S._take_cycle(S._take_cycle(base, 24), 168), "t_index")
    for name in ("seasonal_24", "seasonal_168", "residual"):
        np.testing.assert_allclose(nested[name], stepwise[name], atol=1e-9)


def brute_kpss(x):
    n = len(x)
    e = x - x.mean()
    cover = int(n ** (2 / 9))
    prod = lambda i: e[i:] @ e[: n - i]
    s0, s1 = e @ e / n, 0.0
    for i in range(1, cover + 1):
        s0 += prod(i) / (n / 2)
        s1 += i * prod(i) / (n / 2)
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = e @ e + 2 * sum(prod(i) * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / (var / n), lags


def brute_adf(x, most):
    dy = np.diff(x)

    def ols(lags, start):
        y = dy[start:]
        cols = [x[start:-1]] + [dy[start - k : len(dy) - k] for k in range(1, lags + 1)] + [np.ones(len(y))]
        z = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        rss = ((y - z @ beta) ** 2).sum()
        se = np.sqrt(rss / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
        return beta[0] / se, len(y) * np.log(rss / len(y)) + 2 * z.shape[1]

    best = min(range(most + 1), key=lambda k: ols(k, most)[1])
    return ols(best, best)[0], best


def test_kpss_and_adf_equal_their_definitions(spark):
    rng = np.random.default_rng(7)
    n = 25 * 24
    series = {1: rng.normal(size=n), 2: np.cumsum(rng.normal(size=n)), 3: two_season(n), 4: np.diff(rng.normal(size=n + 1))}
    spec = spec_hourly(25, n_areas=4)
    panel = panel_frame(spark, series, spec)
    kpss = {r["area"]: r for r in ST.kpss(panel, spec).collect()}
    most = ST.adf_max_lag(n)
    for chunk in (150, None):
        adf = {r["area"]: r for r in ST.adf(panel, spec, chunk=chunk).collect()}
        for area, x in series.items():
            stat, lags = brute_adf(x, most)
            assert adf[area]["adf_lags"] == lags
            assert adf[area]["adf_stat"] == pytest.approx(stat, rel=1e-6)
            assert adf[area]["adf_nobs"] == n - 1 - lags
    for area, x in series.items():
        stat, lags = brute_kpss(x)
        assert kpss[area]["kpss_lags"] == lags
        assert kpss[area]["kpss_stat"] == pytest.approx(stat, rel=1e-8)
        table = np.array(ST.KPSS_CRITICAL)
        assert kpss[area]["kpss_pvalue"] == pytest.approx(np.interp(stat, table[:, 0], table[:, 1]))


def test_verdicts_of_a_walk_and_of_noise(spark):
    rng = np.random.default_rng(11)
    n = 25 * 24
    spec = spec_hourly(25, n_areas=2)
    panel = panel_frame(spark, {1: rng.normal(size=n), 2: np.cumsum(rng.normal(size=n))}, spec)
    table = {(r["area"], r["transform"]): r for r in ST.stationarity_table(panel, spec, 24).collect()}
    assert len(table) == 6
    assert table[(1, "raw")]["verdict"] == "stationary (both agree)"
    assert table[(2, "raw")]["verdict"] == "non-stationary (both agree)"
    assert table[(2, "first difference")]["verdict"] == "stationary (both agree)"
    assert table[(2, "seasonal difference (lag 24)")]["n_obs"] == n - 24


def test_mackinnon_reference_points():
    # published 1 %, 5 % and 10 % critical values of the test with a constant
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert ST.mackinnon_p(stat) == pytest.approx(p, abs=0.002)
    assert ST.mackinnon_p(3.0) == 1.0 and ST.mackinnon_p(-20.0) == 0.0


def test_injected_spike_is_flagged_per_phase(spark):
    spec = spec_hourly(28, n_areas=1)
    x = two_season(28 * 24, noise=1.0)
    x[400] += 80
    panel = panel_frame(spark, {1: x}, spec)
    flags = ordered(A.seasonal_anomalies(panel, spec, 24), "t_index")
    assert {400, 424} <= set(flags["t_index"])
    scores = A.scored(panel, spec, 24)
    assert scores.count() == 27 * 24
    rate = A.anomaly_rate(scores).first()
    assert rate["n_evaluable"] == 27 * 24 and rate["n_flagged"] == len(flags)
    res = x[24:] - x[:-24]
    phase = (np.arange(len(res)) + 24) % 24
    sel = res[phase == 400 % 24]
    mad = np.median(np.abs(sel - np.median(sel)))
    row = flags[flags.t_index == 400].iloc[0]
    assert row["scale"] == pytest.approx(1.4826 * mad)


def test_zero_scale_gives_zero_score(spark):
    spec = spec_hourly(4, n_areas=1)
    panel = panel_frame(spark, {1: np.tile(np.arange(24.0), 4)}, spec)
    assert A.scored(panel, spec, 24).agg({"z": "max"}).first()[0] == 0.0


def test_binomial_tail(spark):
    from math import comb

    df = spark.createDataFrame([(0, 5), (3, 10), (10, 10), (35, 152)], "k long, n long")
    got = {(r["k"], r["n"]): r["p"] for r in A.binomial_upper_tail(df, "k", "n", 8 / 62, "p").collect()}
    for (k, n), p in got.items():
        want = sum(comb(n, i) * (8 / 62) ** i * (54 / 62) ** (n - i) for i in range(k, n + 1))
        assert p == pytest.approx(want, rel=1e-9)
    # 35 of 152 flags on 8 of 62 days: the published p value
    assert got[(35, 152)] == pytest.approx(4.3e-4, rel=0.02)


def test_binomial_tail_of_large_counts_and_edges(spark):
    from math import exp, fsum, lgamma, log, log1p

    def brute(k, n, p):
        terms = (lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k, n + 1))
        return fsum(exp(t) for t in terms)

    rows = [(0, 0), (1, 0), (6, 5), (1, 1), (60, 1_000), (100, 1_000), (180, 1_000), (19_800, 200_000), (20_300, 200_000), (None, 4)]
    df = spark.createDataFrame(rows, "k long, n long")
    for r in A.binomial_upper_tail(df, "k", "n", 0.1, "p").collect():
        if r["k"] is None:
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(1.0 if r["k"] == 0 else brute(r["k"], r["n"], 0.1), rel=1e-8)


def test_pacf_of_short_and_constant_series(spark):
    spec = spec_hourly(1, n_areas=2)
    panel = panel_frame(spark, {1: np.full(24, 2.0), 2: np.r_[np.zeros(23), 1.0]}, spec)
    out = S.pacf(panel, spec, 5)
    assert {r["area"] for r in out.collect()} == {2}
    first = {r["lag"]: r["pacf"] for r in out.collect()}
    x = np.r_[np.zeros(23), 1.0]
    assert first[0] == 1.0 and first[1] == pytest.approx(brute_acf(x, 1)[1]) and len(first) == 6


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scales_are_found_without_a_join(spark):
    """The planner takes a filled panel for as small as its roll-up and would send it through the driver."""
    spec = spec_hourly(4, n_areas=2)
    panel = panel_frame(spark, {1: two_season(96), 2: np.zeros(96)}, spec)
    assert "Join" not in plan_of(A.scored(panel, spec, 24))
    rows = A.seasonal_residuals(panel, spec, 24).withColumn("phase", A.F.pmod("t_index", A.F.lit(24)))
    scales = A.robust_scale(rows, ("area", "phase"), "residual")
    assert "Join" not in plan_of(scales)
    got = {(r["area"], r["phase"]): (r["centre"], r["scale"]) for r in scales.collect()}
    assert len(got) == 48 and got[2, 5] == (0.0, 0.0)
    res = two_season(96)
    res = (res[24:] - res[:-24])[7::24]
    assert got[1, 7] == pytest.approx((np.median(res), 1.4826 * np.median(np.abs(res - np.median(res)))))


def test_stationarity_in_place_equals_the_joined_form(spark, monkeypatch):
    """Series that lie whole are tested without a join; longer ones, cut into chunks, give the same figures."""
    rng = np.random.default_rng(5)
    n = 10 * 24
    holed = rng.normal(size=n)
    holed[:30] = np.nan
    spec = spec_hourly(10, n_areas=4)
    panel = panel_frame(spark, {1: rng.normal(size=n), 2: np.cumsum(rng.normal(size=n)), 3: holed, 4: np.full(n, 2.0)}, spec)
    placed = ST.stationarity_table(panel, spec, 24)
    assert "Join" not in plan_of(placed) and "Join" not in plan_of(ST.kpss(panel, spec))
    got = {(r["area"], r["transform"]): r.asDict() for r in placed.collect()}
    monkeypatch.setattr(ST, "PLACED_STEPS", 0)
    want = {(r["area"], r["transform"]): r.asDict() for r in ST.stationarity_table(panel, spec, 24).collect()}
    assert len(want) == 12 and got.keys() == want.keys()
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == (pytest.approx(value, rel=1e-7, nan_ok=True) if isinstance(value, float) else value), (key, name)


def test_lag_products_need_no_join(spark):
    """Chunks are centred on their own mean and moved to that of the series; NULLs, a constant and a level far from zero included."""
    spec = spec_hourly(10, n_areas=3)
    holed = two_season(240, level=1e6)
    holed[[3, 77, 200]] = np.nan
    panel = panel_frame(spark, {1: holed, 2: np.full(240, 0.1), 3: two_season(240)}, spec)
    for chunk in (60, None):
        products = S.lag_products(panel, 20, chunk=chunk)
        assert "Join" not in plan_of(products)
        got = ordered(products, "area", "lag")
        x = np.nan_to_num(holed - np.nanmean(holed))
        mine = got[got.area == 1]
        assert np.allclose(mine["product"], [x[k:] @ x[: 240 - k] for k in range(21)], rtol=1e-9)
        assert set(mine["n"]) == {237} and set(mine["n_rows"]) == {240}
        assert (got[got.area == 2]["product"] == 0).all()


def test_partitions_follow_the_rows_of_the_panel(spark, monkeypatch):
    """A task of a large panel holds no more rows than one of a small panel."""
    from cellpulse.operators import panel as P
    from cellpulse.plans import series as PS

    monkeypatch.setattr(PS, "PARTITION_ROWS", 100)
    spec = spec_hourly(10, n_areas=30)
    rollup = spark.createDataFrame([(1, 5, 2.0, 1)], "area long, t_index long, value double, n_rows long")
    assert P.full_panel(rollup, spec).rdd.getNumPartitions() == 72
