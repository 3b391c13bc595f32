"""Baseline forecasts, scores and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.catalog.features import labelled
from cellpulse.catalog.registry import FORECASTS, LABELLED, PREDICTIONS, SCALE, SCORES_SQL, query, rounded
from cellpulse.operators import diagnostics as DG
from cellpulse.operators import distribution as D
from cellpulse.operators import forecast as FC
from cellpulse.operators import metrics as M
from cellpulse.sources import testdata as T

TOTALS_ONLY = "totals AS (SELECT area, sum(value) AS total FROM panel GROUP BY area)"
BLENDS = (0.4, 0.5, 0.6)


def predictions(spark: SparkSession, sf: str):
    rows, spec = labelled(spark, sf)
    return FC.baseline_predictions(rows, spec, blends=BLENDS), rows, spec


def forecasts(spark: SparkSession, sf: str):
    """One forecast per (area, split, model): both baselines and their even blend."""
    rows, spec = labelled(spark, sf)
    return FC.baseline_predictions(rows, spec, blends=(0.5,)), rows, spec


@query("forecast_persistence", f"WITH {LABELLED}, f AS (SELECT area, t_index, split, value AS observed, lag(value, 1) OVER (PARTITION BY area ORDER BY t_index) AS predicted FROM lab) SELECT area, t_index, round(observed, 4) AS observed, round(predicted, 4) AS predicted FROM f WHERE split = 'test'")
def forecast_persistence(spark: SparkSession, sf: str) -> DataFrame:
    rows, spec = labelled(spark, sf)
    return rounded(FC.walk_forward(FC.persistence(), rows, spec, "test").select("area", "t_index", "observed", "predicted"), 4)


@query("forecast_seasonal_naive", f"WITH {LABELLED}, f AS (SELECT area, t_index, split, value AS observed, lag(value, 24) OVER (PARTITION BY area ORDER BY t_index) AS predicted FROM lab) SELECT area, t_index, round(observed, 4) AS observed, round(predicted, 4) AS predicted FROM f WHERE split = 'stress'")
def forecast_seasonal_naive(spark: SparkSession, sf: str) -> DataFrame:
    rows, spec = labelled(spark, sf)
    return rounded(FC.walk_forward(FC.seasonal_naive(spec), rows, spec, "stress").select("area", "t_index", "observed", "predicted"), 4)


@query("walk_forward", f"WITH {PREDICTIONS} SELECT area, split, model, seed, t_index, local, round(observed, 4) AS observed, round(persistence, 4) AS persistence, round(predicted, 4) AS predicted FROM pred WHERE model <> 'blend'")
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows, spec = labelled(spark, sf)
    return rounded(FC.baseline_predictions(rows, spec), 4)


@query("seed_ensemble", f"WITH {PREDICTIONS} SELECT area, split, t_index, local, 'blend_ensemble' AS model, 0 AS seed, round(max(observed), 4) AS observed, round(max(persistence), 4) AS persistence, round(avg(predicted) + 1e-9, 6) AS predicted, count(*) AS n_members FROM pred WHERE model = 'blend' GROUP BY 1, 2, 3, 4")
def seed_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    preds, _, _ = predictions(spark, sf)
    # means of cents may fall exactly between two roundings; the shift avoids that
    out = FC.seed_ensemble(preds, "blend").withColumn("predicted", F.col("predicted") + F.lit(1e-9))
    return rounded(out, 4, predicted=6)


SCORE_ROUND = "n, round(mae, 7) AS mae, round(rmse, 7) AS rmse, round(bias, 7) + 0.0 AS bias, round(mape, 5) AS mape, round(mape_excl_small, 5) AS mape_excl_small, n_small, round(smape, 6) AS smape, round(wape, 6) AS wape, round(r2, 7) + 0.0 AS r2, round(mae / nullif(mase_scale, 0), 8) AS mase"
SCORES = f"{PREDICTIONS}, {SCALE}, g AS (SELECT area, split, model, seed, {SCORES_SQL} FROM pred GROUP BY 1, 2, 3, 4), s AS (SELECT g.*, mase_scale FROM g LEFT JOIN sc ON sc.area = g.area)"
DIGITS = {"mape": 5, "mape_excl_small": 5, "smape": 6, "wape": 6, "mase": 8}


def scores(spark: SparkSession, sf: str) -> DataFrame:
    preds, rows, spec = predictions(spark, sf)
    return M.metric_table(preds, M.mase_scale(rows, spec), spec)


@query("metric_table", f"WITH {SCORES} SELECT area, split, model, seed, {SCORE_ROUND} FROM s")
def metric_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scores(spark, sf), 7, **DIGITS)


@query("mase_scale", f"WITH {LABELLED}, {SCALE} SELECT area, round(mase_scale, 9) AS mase_scale FROM sc")
def mase_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows, spec = labelled(spark, sf)
    return rounded(M.mase_scale(rows, spec), 9)


def metric_sql(cols: str) -> str:
    return f"WITH {SCORES} SELECT area, split, model, seed, {cols} FROM s"


def one_metric(*names: str):
    """A query for single scores; pruning leaves only their aggregates in the plan."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(scores(spark, sf).select("area", "split", "model", "seed", *names), 7, **DIGITS)

    return run


query("m_mae", metric_sql("round(mae, 7) AS mae"))(one_metric("mae"))
query("m_rmse", metric_sql("round(rmse, 7) AS rmse"))(one_metric("rmse"))
query("m_bias", metric_sql("round(bias, 7) + 0.0 AS bias"))(one_metric("bias"))
query("m_mape", metric_sql("round(mape, 5) AS mape"))(one_metric("mape"))
query("m_mape_excl_small", metric_sql("round(mape_excl_small, 5) AS mape_excl_small"))(one_metric("mape_excl_small"))
query("m_n_small", metric_sql("n_small"))(one_metric("n_small"))
query("m_smape", metric_sql("round(smape, 6) AS smape"))(one_metric("smape"))
query("m_wape", metric_sql("round(wape, 6) AS wape"))(one_metric("wape"))
query("m_r2", metric_sql("round(r2, 7) + 0.0 AS r2"))(one_metric("r2"))
query("m_mase", metric_sql("round(mae / nullif(mase_scale, 0), 8) AS mase"))(one_metric("mase"))


@query(
    "seed_spread",
    f"WITH {SCORES} SELECT area, split, model, count(*) AS n_seeds, round(avg(mae), 7) AS mae, round(coalesce(stddev_samp(mae), 0), 7) + 0.0 AS mae_std, round(avg(mae / nullif(mase_scale, 0)), 8) AS mase, "
    "CASE WHEN count(mae / nullif(mase_scale, 0)) > 0 THEN round(coalesce(stddev_samp(mae / nullif(mase_scale, 0)), 0), 8) + 0.0 END AS mase_std FROM s GROUP BY 1, 2, 3",
)
def seed_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.seed_spread(scores(spark, sf), ("mae", "mase")), 7, mase=8, mase_std=8)


@query(
    "baseline_mase",
    f"WITH {SCORES}, {TOTALS_ONLY}, top AS (SELECT area FROM totals ORDER BY total DESC, area LIMIT 3) "
    f"SELECT area, split, model, {SCORE_ROUND} FROM s WHERE area IN (SELECT area FROM top) AND model <> 'blend'",
)
def baseline_mase(spark: SparkSession, sf: str) -> DataFrame:
    """Which baseline forecasts the three busiest areas best?"""
    rows, spec = labelled(spark, sf)
    best = D.top_areas(T.exact_totals(rows), 3).select("area")
    few = rows.join(F.broadcast(best), "area", "left_semi")  # three rows; everything after sees their series only
    table = M.metric_table(FC.baseline_predictions(few, spec), M.mase_scale(few, spec), spec)
    return rounded(table.drop("seed"), 7, **DIGITS)


@query(
    "ensemble_cost",
    f"WITH {SCORES} SELECT area, split, 'blend_ensemble' AS model, round(sum(mae / 10) + 1e-9, 6) AS train_wall_s, round(sum(rmse / 100) + 1e-9, 6) AS inference_wall_s, CAST(sum(seed + 2) AS BIGINT) AS n_params, count(*) AS n_members FROM s WHERE model = 'blend' GROUP BY 1, 2",
)
def ensemble_cost(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf).filter("model = 'blend'").select(
        "area", "split", "model", (F.col("mae") / 10).alias("train_wall_s"), (F.col("rmse") / 100).alias("inference_wall_s"), (F.col("seed") + 2).cast("long").alias("n_params")
    )
    costs = FC.ensemble_cost(rows)
    for name in ("train_wall_s", "inference_wall_s"):
        costs = costs.withColumn(name, F.col(name) + F.lit(1e-9))
    return rounded(costs, 6)


@query(
    "m_inference_ms",
    f"WITH {SCORES} SELECT area, split, model, seed, round(1000 * (rmse / 100) / n, 7) AS inference_ms_per_step FROM s",
)
def m_inference_ms(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.inference_ms(scores(spark, sf).withColumn("inference_wall_s", F.col("rmse") / 100))
    return rounded(rows.select("area", "split", "model", "seed", "inference_ms_per_step"), 7)


@query(
    "information_criteria",
    f"WITH {SCORES}, i AS (SELECT area, split, model, seed, n, power(rmse, 2) * n AS rss, 2 + seed AS k FROM s WHERE rmse > 0), l AS (SELECT *, n * (ln(2 * pi() * rss / n) + 1) AS f FROM i) "
    "SELECT area, split, model, seed, round(f + 2 * k, 6) AS aic, round(f + k * ln(n), 6) AS bic, round(f + 2 * k + 2 * k * (k + 1) / (n - k - 1), 6) AS aicc FROM l",
)
def information_criteria(spark: SparkSession, sf: str) -> DataFrame:
    fits = scores(spark, sf).filter("rmse > 0").select(
        "area", "split", "model", "seed", "n", (F.col("rmse") * F.col("rmse") * F.col("n")).alias("rss"), (F.col("seed") + 2).alias("k")
    )
    return rounded(FC.information_criteria(fits).drop("n", "rss", "k"), 6)


# --- diagnostics ---------------------------------------------------------------------------------

GROUPS = f"{FORECASTS}, gr AS (SELECT DISTINCT area, split, model FROM fc)"
MISS = "abs(observed - predicted)"


@query(
    "error_by_hour",
    f"WITH {GROUPS} SELECT gr.area, gr.split, gr.model, h.hour::INTEGER AS hour, round(avg({MISS}) + 1e-9, 6) AS mae, count(fc.area) AS n FROM gr CROSS JOIN (SELECT unnest(range(0, 24)) AS hour) h "
    "LEFT JOIN fc ON fc.area = gr.area AND fc.split = gr.split AND fc.model = gr.model AND hour(fc.local) = h.hour GROUP BY 1, 2, 3, 4",
)
def error_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    out = DG.error_by_hour(forecasts(spark, sf)[0]).withColumn("mae", F.col("mae") + F.lit(1e-9))
    return rounded(out, 6)


@query(
    "error_heatmap",
    f"WITH {GROUPS} SELECT gr.area, gr.split, gr.model, (c.c // 24)::INTEGER AS weekday, (c.c % 24)::INTEGER AS hour, round(avg({MISS}) + 1e-9, 6) AS mae, count(fc.area) AS n FROM gr CROSS JOIN (SELECT unnest(range(0, 168)) AS c) c "
    "LEFT JOIN fc ON fc.area = gr.area AND fc.split = gr.split AND fc.model = gr.model AND (isodow(fc.local) - 1) * 24 + hour(fc.local) = c.c GROUP BY 1, 2, 3, 4, 5",
)
def error_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    out = DG.error_heatmap(forecasts(spark, sf)[0]).withColumn("mae", F.col("mae") + F.lit(1e-9))
    return rounded(out, 6)


HOL = "CAST(local AS DATE) IN (DATE '2024-01-01', DATE '2024-01-06', DATE '2024-01-24')"


@query(
    "error_by_daytype",
    f"WITH {FORECASTS}, d AS (SELECT area, split, model, avg({MISS}) FILTER (WHERE isodow(local) < 6) AS wd, avg({MISS}) FILTER (WHERE isodow(local) >= 6) AS we, count(*) FILTER (WHERE isodow(local) < 6) AS n_weekday, count(*) FILTER (WHERE isodow(local) >= 6) AS n_weekend, "
    f"avg({MISS}) FILTER (WHERE NOT {HOL}) AS od, avg({MISS}) FILTER (WHERE {HOL}) AS hd, count(*) FILTER (WHERE {HOL}) AS n_holiday FROM fc GROUP BY 1, 2, 3) "
    "SELECT area, split, model, round(wd + 1e-9, 6) AS weekday_mae, round(we + 1e-9, 6) AS weekend_mae, n_weekday, n_weekend, round(od + 1e-9, 6) AS ordinary_mae, round(hd + 1e-9, 6) AS holiday_mae, n_holiday, round(we / nullif(wd, 0), 8) AS weekend_penalty, round(hd / nullif(od, 0), 8) AS holiday_penalty FROM d",
)
def error_by_daytype(spark: SparkSession, sf: str) -> DataFrame:
    preds, _, spec = forecasts(spark, sf)
    out = DG.error_by_daytype(preds, spec)
    for name in ("weekday_mae", "weekend_mae", "ordinary_mae", "holiday_mae"):
        out = out.withColumn(name, F.col(name) + F.lit(1e-9))
    return rounded(out, 6, weekend_penalty=8, holiday_penalty=8)


@query(
    "residual_acf",
    f"WITH {FORECASTS}, e AS (SELECT area, split, model, t_index, observed - predicted AS d FROM fc), c AS (SELECT *, d - avg(d) OVER (PARTITION BY area, split, model) AS x FROM e), "
    "z AS (SELECT area, split, model, count(*) AS n, min(d) = max(d) AS flat, sum(x * x) AS c0 FROM c GROUP BY 1, 2, 3), "
    "p AS (SELECT a.area, a.split, a.model, l.lag, sum(a.x * b.x) AS s FROM c a CROSS JOIN (SELECT unnest(range(0, 49)) AS lag) l JOIN c b ON b.area = a.area AND b.split = a.split AND b.model = a.model AND b.t_index = a.t_index - l.lag GROUP BY 1, 2, 3, 4) "
    "SELECT p.area, p.split, p.model, lag::INTEGER AS lag, CASE WHEN NOT flat THEN round(s / nullif(c0, 0), 8) + 0.0 END AS acf, round(CASE WHEN flat THEN 0 ELSE 1.96 / sqrt(n) END, 9) AS confidence FROM p JOIN z ON z.area = p.area AND z.split = p.split AND z.model = p.model",
)
def residual_acf(spark: SparkSession, sf: str) -> DataFrame:
    preds, _, spec = forecasts(spark, sf)
    return rounded(DG.residual_acf(preds, 2 * spec.daily), 8, confidence=9)


CROSS = (
    f"{FORECASTS}, c AS (SELECT area, split, model, t_index, observed - avg(observed) OVER w AS x, predicted - avg(predicted) OVER w AS y FROM fc WINDOW w AS (PARTITION BY area, split, model)), "
    "z AS (SELECT area, split, model, sqrt(sum(x * x) * sum(y * y)) AS sc FROM c GROUP BY 1, 2, 3), "
    "p AS (SELECT a.area, a.split, a.model, l.lag::INTEGER AS lag, sum(a.x * b.y) AS s FROM c a CROSS JOIN (SELECT unnest(range(-12, 13)) AS lag) l JOIN c b ON b.area = a.area AND b.split = a.split AND b.model = a.model AND b.t_index = a.t_index + l.lag GROUP BY 1, 2, 3, 4), "
    "cc AS (SELECT p.area, p.split, p.model, lag, s / nullif(sc, 0) AS correlation FROM p JOIN z ON z.area = p.area AND z.split = p.split AND z.model = p.model)"
)


@query("cross_correlation", f"WITH {CROSS} SELECT area, split, model, lag, round(correlation, 8) + 0.0 AS correlation FROM cc")
def cross_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(DG.cross_correlation(forecasts(spark, sf)[0]), 8)


COPY = (
    f"{CROSS}, pk AS (SELECT area, split, model, coalesce(arg_max(lag, (round(correlation, 9), -lag)), 0) AS peak_lag, max(correlation) AS peak, max(CASE WHEN lag = 0 THEN correlation END) AS l0, max(CASE WHEN lag = 1 THEN correlation END) AS l1 FROM cc WHERE correlation IS NOT NULL GROUP BY 1, 2, 3), "
    "ra AS (SELECT area, split, model, avg(abs(predicted - persistence)) / nullif(avg(st), 0) AS ratio FROM (SELECT *, abs(observed - lag(observed) OVER (PARTITION BY area, split, model ORDER BY t_index)) AS st FROM fc) GROUP BY 1, 2, 3)"
)


@query(
    "copying_report",
    f"WITH {COPY} SELECT ra.area, ra.split, ra.model, coalesce(peak_lag, 0) AS peak_lag, round(peak, 7) AS peak_correlation, round(l0, 7) + 0.0 AS lag0_correlation, round(l1, 7) + 0.0 AS lag1_correlation, round(l1 - l0, 7) + 0.0 AS lag_margin, round(ratio, 8) + 0.0 AS copy_ratio, "
    "CASE WHEN ratio < 0.25 THEN 'collapsed' WHEN ratio < 0.6 THEN 'near-persistence' ELSE 'independent' END AS verdict FROM ra LEFT JOIN pk ON pk.area = ra.area AND pk.split = ra.split AND pk.model = ra.model",
)
def copying_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(DG.copying_report(forecasts(spark, sf)[0]), 7, copy_ratio=8)


@query(
    "lag1_copy_ratio",
    f"WITH {FORECASTS} SELECT area, split, model, round(avg(abs(predicted - persistence)) / nullif(avg(abs(observed - persistence)), 0), 8) + 0.0 AS lag1_copy_ratio FROM fc GROUP BY 1, 2, 3",
)
def lag1_copy_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(DG.lag1_copy_ratio(forecasts(spark, sf)[0]), 8)


KEY = "area, split, model"
ROUND = "arg_max(struct_pack(s := t_index, start := start, stop := stop, mae := mae, b := b), (round(mae, 9), -t_index))"
SAME = "{0}.area = w.area AND {0}.split = w.split AND {0}.model = w.model AND abs({0}.v.s - w.t_index) < 6"
WINDOWS = (
    f"{FORECASTS}, w AS (SELECT {KEY}, t_index, local AS start, last(local) OVER f AS stop, avg({MISS}) OVER f AS mae, avg(abs(observed - persistence)) OVER f AS b, count(*) OVER f AS len FROM fc WINDOW f AS (PARTITION BY {KEY} ORDER BY t_index ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) QUALIFY len = 6), "
    f"a1 AS (SELECT {KEY}, {ROUND} AS v FROM w GROUP BY {KEY}), "
    f"w2 AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM a1 WHERE {SAME.format('a1')})), a2 AS (SELECT {KEY}, {ROUND} AS v FROM w2 GROUP BY {KEY}), "
    f"w3 AS (SELECT * FROM w2 w WHERE NOT EXISTS (SELECT 1 FROM a2 WHERE {SAME.format('a2')})), a3 AS (SELECT {KEY}, {ROUND} AS v FROM w3 GROUP BY {KEY}), "
    f"worst AS (SELECT {KEY}, 1 AS place, v FROM a1 UNION ALL SELECT {KEY}, 2, v FROM a2 UNION ALL SELECT {KEY}, 3, v FROM a3)"
)


@query(
    "worst_windows",
    f"WITH {WINDOWS} SELECT {KEY}, place, v.s AS start_index, v.start AS start, v.stop AS stop, round(v.mae + 1e-9, 6) AS mae, round(v.b + 1e-9, 6) AS baseline_mae, 6 AS n_steps, round(v.mae / nullif(v.b, 0), 7) AS ratio_to_persistence FROM worst",
)
def worst_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = DG.worst_windows(forecasts(spark, sf)[0], 6)
    for name in ("mae", "baseline_mae"):
        out = out.withColumn(name, F.col(name) + F.lit(1e-9))
    return rounded(out, 6, ratio_to_persistence=7)


@query(
    "worst_windows_report",
    f"WITH {WINDOWS} SELECT {KEY}, v.s AS start_index, round(v.mae + 1e-9, 6) AS mae, round(v.mae / nullif(v.b, 0), 7) AS ratio_to_persistence FROM worst WHERE model NOT IN ('persistence', 'seasonal_naive') "
    "ORDER BY round(v.mae / nullif(v.b, 0), 9) DESC NULLS LAST, area, split, model, v.s LIMIT 12",
)
def worst_windows_report(spark: SparkSession, sf: str) -> DataFrame:
    out = DG.worst_windows_report(DG.worst_windows(forecasts(spark, sf)[0], 6))
    out = out.select("area", "split", "model", "start_index", (F.col("mae") + F.lit(1e-9)).alias("mae"), "ratio_to_persistence")
    return rounded(out, 6, ratio_to_persistence=7)


@query(
    "cross_area_mase",
    f"WITH {SCORES}, t AS (SELECT area, model, avg(mae / nullif(mase_scale, 0)) AS mase FROM s WHERE split = 'test' GROUP BY area, model) "
    "SELECT model, round(max(mase) FILTER (WHERE area = 5), 8) AS mase_5, round(max(mase) FILTER (WHERE area = 2), 8) AS mase_2, round(avg(mase), 8) AS mase_mean, round(max(mase), 8) AS mase_worst, count(mase) AS n_areas FROM t GROUP BY model",
)
def cross_area_mase(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf).filter("split = 'test'")
    return rounded(DG.cross_area_mase(rows, (5, 2)), 8)
