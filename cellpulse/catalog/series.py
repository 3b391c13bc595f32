"""Time-series characterisation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.catalog.registry import PANEL, SUPPLIERS, query, rounded
from cellpulse.operators import anomalies as A
from cellpulse.operators import panel as P
from cellpulse.operators import series as S
from cellpulse.operators import stationarity as ST
from cellpulse.sources import testdata as T

W = "OVER (PARTITION BY area ORDER BY t_index"


@query(
    "difference",
    f"WITH {PANEL} SELECT area, t_index, round(value - lag(value, 1) {W}), 4) + 0.0 AS diff_1, round(value - lag(value, 24) {W}), 4) + 0.0 AS diff_24 FROM panel",
)
def difference(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    from cellpulse.plans.series import over_series

    out = over_series(
        panel.select("area", "t_index", "value"),
        lambda w: {f"diff_{k}": F.col("value") - F.lag("value", k).over(w) for k in (1, spec.daily)},
        before=spec.daily,
    )
    return rounded(out.drop("value"), 4)


@query(
    "rolling_stats",
    f"WITH {SUPPLIERS} SELECT area, t_index, round(avg(value) {W} ROWS BETWEEN 26 PRECEDING AND CURRENT ROW), 4) + 0.0 AS roll_mean, round(stddev_pop(value) {W} ROWS BETWEEN 26 PRECEDING AND CURRENT ROW), 3) + 0.0 AS roll_std FROM panel QUALIFY t_index >= 26",
)
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.supplier_daily(spark, sf)
    out = S.rolling_stats(panel.select("area", "t_index", "value"), 27)
    return rounded(out.select("area", "t_index", "roll_mean", "roll_std"), 4, roll_std=3)


N_LAGS = 180
ACF_SQL = (
    f"{PANEL}, c AS (SELECT area, t_index, value - avg(value) OVER (PARTITION BY area) AS x FROM panel), "
    f"p AS (SELECT a.area, l.lag, sum(a.x * b.x) AS s FROM c a CROSS JOIN (SELECT unnest(range(0, {N_LAGS + 1})) AS lag) l JOIN c b ON b.area = a.area AND b.t_index = a.t_index - l.lag GROUP BY 1, 2), "
    "rho AS (SELECT area, lag, s / nullif(first_value(s) OVER (PARTITION BY area ORDER BY lag), 0) AS acf FROM p), "
    "band AS (SELECT area, lag, acf, CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf ELSE 0 END) OVER (PARTITION BY area ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 720) END AS half FROM rho)"
)


@query("acf", f"WITH {ACF_SQL} SELECT area, lag::INTEGER AS lag, round(acf, 8) + 0.0 AS acf, round(acf - half, 8) + 0.0 AS lower, round(acf + half, 8) + 0.0 AS upper FROM band")
def acf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.acf(T.events_panel(spark, sf)[0], N_LAGS).drop("n"), 8)


@query(
    "acf_peaks",
    f"WITH {ACF_SQL}, s AS (SELECT area, lag, acf, lag(acf) OVER (PARTITION BY area ORDER BY lag) AS le, lead(acf) OVER (PARTITION BY area ORDER BY lag) AS ri FROM rho), "
    "k AS (SELECT area, lag::INTEGER AS lag, acf FROM s WHERE lag >= 2 AND acf > le AND acf > ri AND acf > 0.05) "
    "SELECT area, lag, round(acf, 8) AS acf, (row_number() OVER (PARTITION BY area ORDER BY acf DESC, lag))::INTEGER AS position FROM k QUALIFY position <= 10",
)
def acf_peaks(spark: SparkSession, sf: str) -> DataFrame:
    # the test events carry no cycle, so the floor is lowered to find any peak
    rows = S.acf(T.events_panel(spark, sf)[0], N_LAGS)
    return rounded(S.acf_peaks(rows, floor=0.05), 8)


@query(
    "pacf",
    f"WITH RECURSIVE {ACF_SQL}, rh AS (SELECT area, list(acf ORDER BY lag) AS rho FROM rho WHERE lag <= 60 AND acf IS NOT NULL GROUP BY area), "
    "lv AS (SELECT area, rho, 1 AS k, [rho[2]] AS phi, 1 - rho[2] * rho[2] AS err, rho[2] AS q FROM rh UNION ALL "
    "SELECT area, rho, k + 1, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda x: x[1] - q * x[2]), q), err * (1 - q * q), q "
    "FROM (SELECT area, rho, k, phi, err, (rho[k + 2] - list_sum(list_transform(list_zip(phi, list_reverse(rho[2:k + 1])), lambda x: x[1] * x[2]))) / err AS q FROM lv WHERE k < 60) s) "
    "SELECT area, k::INTEGER AS lag, round(q, 8) + 0.0 AS pacf, round(q - 1.959963984540054 / sqrt(720), 8) + 0.0 AS lower, round(q + 1.959963984540054 / sqrt(720), 8) + 0.0 AS upper FROM lv "
    "UNION ALL SELECT area, 0, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM rh",
)
def pacf(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(S.pacf(panel, spec, 60), 8)


@query(
    "periodogram_peaks",
    f"WITH {PANEL}, f AS (SELECT p.area, k.k, sum(p.value * cos(2 * pi() * (k.k * p.t_index % 720) / 720)) AS re, sum(p.value * sin(2 * pi() * (k.k * p.t_index % 720) / 720)) AS im FROM panel p CROSS JOIN (SELECT unnest(range(1, 361)) AS k) k GROUP BY 1, 2), "
    "w AS (SELECT area, k, k / 720.0 AS frequency_per_hour, (CASE WHEN k = 360 THEN 1 ELSE 2 END) * (re * re + im * im) / 720.0 AS power FROM f) "
    "SELECT area, k::INTEGER AS k, round(frequency_per_hour, 9)::DOUBLE AS frequency_per_hour, round(power, 4) AS power, (row_number() OVER (PARTITION BY area ORDER BY power DESC, k))::INTEGER AS position, round(720.0 / k, 6)::DOUBLE AS period_hours FROM w QUALIFY position <= 6",
)
def periodogram_peaks(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(S.periodogram_peaks(panel, spec), 4, frequency_per_hour=9, period_hours=6)


def _cycle_sql(source: str, period: int) -> str:
    return (
        f"m{period} AS (SELECT area, t_index % {period} AS ph, avg(r) AS m FROM {source} GROUP BY 1, 2), "
        f"c{period} AS (SELECT area, ph, m - avg(m) OVER (PARTITION BY area) AS s{period} FROM m{period})"
    )


DECOMP_SQL = (
    f"{PANEL}, t0 AS (SELECT area, t_index, value, avg(value) {W} ROWS BETWEEN 84 PRECEDING AND 84 FOLLOWING) AS trend FROM panel), "
    f"r0 AS (SELECT *, value - trend AS r FROM t0), {_cycle_sql('r0', 24)}, "
    f"r1 AS (SELECT r0.area, t_index, value, trend, s24, r - s24 AS r FROM r0 JOIN c24 ON c24.area = r0.area AND c24.ph = t_index % 24), {_cycle_sql('r1', 168)}, "
    "d AS (SELECT r1.area, t_index, value, trend, s24 AS seasonal_24, s168 AS seasonal_168, r - s168 AS residual FROM r1 JOIN c168 ON c168.area = r1.area AND c168.ph = t_index % 168)"
)


@query(
    "seasonal_decompose",
    f"WITH {DECOMP_SQL} SELECT area, t_index, round(trend + 1e-9, 7) + 0.0 AS trend, round(seasonal_24, 7) + 0.0 AS seasonal_24, round(seasonal_168, 7) + 0.0 AS seasonal_168, round(residual, 7) + 0.0 AS residual FROM d",
)
def seasonal_decompose(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    out = S.seasonal_decompose(panel.select("area", "t_index", "value"), spec, (spec.daily, spec.weekly))
    # edge frames hold 2^k values whose means fall exactly between two roundings; the shift avoids that
    return rounded(out.drop("value").withColumn("trend", F.col("trend") + F.lit(1e-9)), 7)


@query(
    "component_strength",
    f"WITH {DECOMP_SQL}, v AS (SELECT area, stddev_pop(value) AS observed_std, stddev_pop(residual) AS residual_std, var_pop(value) AS o, var_pop(residual) AS r, var_pop(trend) AS vt, var_pop(trend + residual) AS ct, "
    "var_pop(seasonal_24) AS vd, var_pop(seasonal_24 + residual) AS cd, var_pop(seasonal_168) AS vw, var_pop(seasonal_168 + residual) AS cw FROM d GROUP BY area), "
    "u AS (SELECT area, observed_std, residual_std, 'trend' AS component, vt / o AS variance_share, greatest(0, 1 - r / ct) AS strength FROM v UNION ALL "
    "SELECT area, observed_std, residual_std, 'seasonal_24', vd / o, greatest(0, 1 - r / cd) FROM v UNION ALL SELECT area, observed_std, residual_std, 'seasonal_168', vw / o, greatest(0, 1 - r / cw) FROM v UNION ALL "
    "SELECT area, observed_std, residual_std, 'residual', r / o, NULL FROM v) "
    "SELECT area, round(observed_std, 7) AS observed_std, round(residual_std, 7) AS residual_std, component, round(variance_share, 8) AS variance_share, round(strength, 8) AS strength FROM u",
)
def component_strength(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    periods = (spec.daily, spec.weekly)
    out = S.component_strength(S.seasonal_decompose(panel.select("area", "t_index", "value"), spec, periods), periods)
    return rounded(out, 8, observed_std=7, residual_std=7)


KPSS_SQL = (
    f"{PANEL}, c AS (SELECT area, t_index, value - avg(value) OVER (PARTITION BY area) AS e FROM panel), "
    f"s AS (SELECT area, sum(s * s) / (720.0 * 720.0) AS eta FROM (SELECT area, sum(e) {W}) AS s FROM c) GROUP BY area), "
    "p AS (SELECT a.area, l.lag, sum(a.e * b.e) AS g FROM c a CROSS JOIN (SELECT unnest(range(0, 60)) AS lag) l JOIN c b ON b.area = a.area AND b.t_index = a.t_index - l.lag GROUP BY 1, 2), "
    "q AS (SELECT area, sum(CASE WHEN lag = 0 THEN g / 720.0 WHEN lag <= 4 THEN g / 360.0 END) AS s0, sum(CASE WHEN lag BETWEEN 1 AND 4 THEN lag * g / 360.0 END) AS s1 FROM p GROUP BY area), "
    "b AS (SELECT area, least(719, floor(1.1447 * power(power(s1 / s0, 2), 1.0 / 3.0) * power(720.0, 1.0 / 3.0)))::INTEGER AS l FROM q), "
    "v AS (SELECT p.area, max(l) AS l, sum(CASE WHEN lag = 0 THEN g WHEN lag <= l THEN 2 * g * (1 - lag / (l + 1.0)) ELSE 0 END) / 720.0 AS lrv FROM p JOIN b ON b.area = p.area GROUP BY p.area), "
    "k AS (SELECT v.area, 720::BIGINT AS n_obs, l AS kpss_lags, eta / lrv AS x FROM v JOIN s ON s.area = v.area)"
)


@query(
    "kpss",
    f"WITH {KPSS_SQL} SELECT area, n_obs, kpss_lags, round(x, 7) AS kpss_stat, round(CASE WHEN x <= 0.347 THEN 0.1 WHEN x <= 0.463 THEN 0.1 + (x - 0.347) * (0.05 - 0.1) / (0.463 - 0.347) "
    "WHEN x <= 0.574 THEN 0.05 + (x - 0.463) * (0.025 - 0.05) / (0.574 - 0.463) WHEN x <= 0.739 THEN 0.025 + (x - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END, 7) AS kpss_pvalue FROM k",
)
def kpss(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(ST.kpss(panel, spec), 7)


@query("adf")
def adf(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(ST.adf(panel, spec), 7)


@query("stationarity_table")
def stationarity_table(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(ST.stationarity_table(panel, spec, spec.daily), 7)


def scored_sql(phase: str) -> str:
    return (
        f"r AS (SELECT area, t_index, local, value, {phase} AS phase, residual FROM (SELECT area, t_index, local, value, value - lag(value, 24) {W}) AS residual FROM panel) WHERE t_index >= 24), "
        "m AS (SELECT area, phase, quantile_cont(residual, 0.5) AS centre, stddev_pop(residual) AS sd FROM r GROUP BY 1, 2), "
        "a AS (SELECT r.area, r.phase, quantile_cont(abs(residual - centre), 0.5) AS mad FROM r JOIN m ON m.area = r.area AND m.phase = r.phase GROUP BY 1, 2), "
        "sc AS (SELECT m.area, m.phase, centre, CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END AS scale FROM m JOIN a ON a.area = m.area AND a.phase = m.phase), "
        "z AS (SELECT r.*, scale, coalesce(abs(residual - centre) / nullif(scale, 0), 0) AS z FROM r JOIN sc ON sc.area = r.area AND sc.phase = r.phase)"
    )


Z_SQL = f"{PANEL}, {scored_sql('t_index % 24')}"


@query("robust_scale", f"WITH {Z_SQL} SELECT area, phase, round(centre, 6) + 0.0 AS centre, round(scale, 6) + 0.0 AS scale FROM sc")
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    rows = A.seasonal_residuals(panel, spec, spec.daily).withColumn("phase", F.pmod("t_index", F.lit(spec.daily)))
    return rounded(A.robust_scale(rows, ("area", "phase"), "residual"), 6)


@query(
    "seasonal_anomalies",
    f"WITH {Z_SQL} SELECT area, t_index, round(value, 4) AS value, round(residual, 4) + 0.0 AS residual, round(scale, 6) AS scale, round(z, 6) AS z FROM z WHERE z > 4",
)
def seasonal_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    out = A.seasonal_anomalies(panel, spec, spec.daily)
    return rounded(out.select("area", "t_index", "value", "residual", "scale", "z"), 4, scale=6, z=6)


@query(
    "seasonal_anomalies_global",
    f"WITH {PANEL}, {scored_sql('0')} SELECT area, t_index, round(residual, 4) + 0.0 AS residual, round(z, 6) AS z FROM z WHERE z > 4",
)
def seasonal_anomalies_global(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    out = A.seasonal_anomalies(panel, spec, spec.daily, per_phase=False)
    return rounded(out.select("area", "t_index", "residual", "z"), 4, z=6)


@query(
    "anomaly_rate",
    f"WITH {Z_SQL} SELECT area, count(*) FILTER (WHERE z > 4) AS n_flagged, count(*) AS n_evaluable, round(avg(CASE WHEN z > 4 THEN 1.0 ELSE 0.0 END), 9) AS fraction_flagged, round(quantile_cont(scale, 0.5), 6) AS scale FROM z GROUP BY area",
)
def anomaly_rate(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(A.anomaly_rate(A.scored(panel, spec, spec.daily)), 6, fraction_flagged=9)


HOLIDAYS = (
    "hol AS (SELECT * FROM (VALUES (DATE '2024-01-01', 'Capodanno (New Year''s Day)'), (DATE '2024-01-06', 'Epifania (Epiphany)'), (DATE '2024-01-24', 'Local observance')) v(date, holiday))"
)


@query(
    "holiday_flags",
    f"WITH {PANEL} SELECT area, t_index, CAST(local AS DATE) IN (DATE '2024-01-01', DATE '2024-01-06', DATE '2024-01-24') AS is_holiday, CAST(local AS DATE) IN (DATE '2024-01-01', DATE '2024-01-06') AS is_official FROM panel",
)
def holiday_flags(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    every = P.holiday_flags(panel.select("area", "t_index", "local"), spec)
    official = P.holiday_flags(every.withColumnRenamed("is_holiday", "any"), spec, include_observances=False)
    return official.select("area", "t_index", F.col("any").alias("is_holiday"), F.col("is_holiday").alias("is_official"))


@query(
    "holiday_dim",
    f"WITH {HOLIDAYS} SELECT hol.date, hol.holiday AS name, CASE WHEN hol.holiday = 'Local observance' THEN 'observance' ELSE 'national' END AS scope, count(event_id) AS n_events FROM hol LEFT JOIN events ON CAST(ts AS DATE) = hol.date GROUP BY 1, 2, 3",
)
def holiday_dim(spark: SparkSession, sf: str) -> DataFrame:
    per_day = T.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    days = A.holiday_dim(spark, T.HOURLY).drop("note")
    return days.join(per_day, "date", "left").select("date", "name", "scope", F.coalesce("n", F.lit(0).cast("long")).alias("n_events"))


ENRICHED = f"{Z_SQL}, {HOLIDAYS}, en AS (SELECT z.*, CAST(local AS DATE) AS date, dayname(local) AS weekday, hol.holiday, hol.holiday IS NOT NULL AS is_holiday FROM z LEFT JOIN hol ON hol.date = CAST(local AS DATE) WHERE z > 4)"


@query(
    "anomaly_enrich",
    f"WITH {ENRICHED} SELECT area, t_index, date, weekday, holiday, is_holiday, round(value, 4) AS value, round(residual, 4) + 0.0 AS residual, round(z, 6) AS z FROM en",
)
def anomaly_enrich(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    out = A.anomaly_enrich(A.seasonal_anomalies(panel, spec, spec.daily), spec)
    return rounded(out.select("area", "t_index", "date", "weekday", "holiday", "is_holiday", "value", "residual", "z"), 4, z=6)


@query(
    "anomalies_per_date",
    f"WITH {ENRICHED} SELECT date, count(*) AS n, count(DISTINCT area) AS n_areas, round(max(z), 6) AS max_z FROM en GROUP BY date",
)
def anomalies_per_date(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    out = A.anomaly_enrich(A.seasonal_anomalies(panel, spec, spec.daily), spec)
    return rounded(A.anomalies_per_date(out), 6)


@query(
    "holiday_enrichment",
    f"WITH {ENRICHED}, c AS (SELECT count(*) FILTER (WHERE is_holiday) AS k, count(*) AS n FROM en), i AS (SELECT unnest(range(0, (SELECT n FROM c) + 1)) AS i), "
    "t AS (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.1) + (n - i) * ln(0.9))) AS p FROM c, i WHERE i >= k) "
    "SELECT k AS on_holiday, n AS n_flagged, round(k / n, 9) AS share_on_holidays, round(0.1::DOUBLE, 9) AS share_of_days, round(k / n / 0.1, 8) AS enrichment, round(least(1.0, p), 7) AS p_value FROM c, t",
)
def holiday_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    out = A.anomaly_enrich(A.seasonal_anomalies(panel, spec, spec.daily), spec)
    return rounded(A.holiday_enrichment(out, spec), 9, enrichment=8, p_value=7)
