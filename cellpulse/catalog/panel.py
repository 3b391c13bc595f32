"""Panel and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.catalog.registry import AREAS, OBS, PANEL, SPLIT, TEN, TENS, query, r, rounded
from cellpulse.functions import exprs as X
from cellpulse.operators import panel as P
from cellpulse.operators import quality as Q
from cellpulse.sources import testdata as T

RAW_SQL = (
    "SELECT user_id + 1 AS square_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS time_ms, "
    "CASE event_type WHEN 'click' THEN 39 WHEN 'error' THEN 33 WHEN 'purchase' THEN 44 WHEN 'signup' THEN 49 WHEN 'view' THEN 1 END AS country_code, "
    "value AS internet FROM events"
)


@query(
    "null_fill",
    "SELECT event_type, count(*) AS n, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS n_null, "
    "round(sum(coalesce(v, 0.0)), 4) + 0.0 AS total "
    "FROM (SELECT event_type, nullif(value, round(value)) AS v FROM events) GROUP BY 1",
)
def null_fill(spark: SparkSession, sf: str) -> DataFrame:
    # whole-numbered activity plays the empty field
    raw = T.table(spark, sf, "events").select("event_type", F.nullif("value", F.round("value")).alias("v"))
    filled = P.null_fill(raw.withColumn("was_null", F.col("v").isNull()), "v")
    return filled.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("was_null").alias("n_null"), r(F.sum("v"), 4).alias("total")
    )


@query("country_rollup", f"WITH {OBS} SELECT area, t_index, round(value, 4) AS value, n_rows FROM obs")
def country_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.events_rollup(spark, sf), 4)


@query(
    "rows_per_cell",
    f"WITH {OBS} SELECT count(*) AS n_cells, round(avg(n_rows), 9) AS mean_rows, max(n_rows) AS max_rows FROM obs",
)
def rows_per_cell(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.rows_per_cell(T.events_rollup(spark, sf)), 9)


@query(
    "country_codes_per_day",
    "SELECT CAST(ts AS DATE) AS date, count(DISTINCT event_type) AS n_codes FROM events GROUP BY 1",
)
def country_codes_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return P.country_codes_per_day(T.events_raw(spark, sf), T.HOURLY)


@query(
    "densify",
    f"WITH {OBS}, {AREAS}, seen AS (SELECT DISTINCT t_index FROM obs) "
    "SELECT a.area, s.t_index, round(coalesce(o.value, 0.0), 4) AS value, coalesce(o.n_rows, 0) AS n_rows "
    "FROM areas a CROSS JOIN seen s LEFT JOIN obs o ON o.area = a.area AND o.t_index = s.t_index",
)
def densify(spark: SparkSession, sf: str) -> DataFrame:
    spec = T.hourly_spec(spark, sf)
    return rounded(P.densify(T.events_rollup(spark, sf, spec), spec), 4)


@query(
    "day_stats",
    f"WITH {OBS}, n AS (SELECT max(user_id) + 1 AS n FROM events), d AS (SELECT CAST(TIMESTAMP '2024-01-01' + to_hours(t_index) AS DATE) AS date, "
    "CAST(sum(n_rows) AS BIGINT) AS n_raw_rows, count(*) AS n_pairs, count(DISTINCT t_index) AS n_timestamps, sum(value) AS total FROM obs GROUP BY 1) "
    "SELECT date, n_raw_rows, n_pairs, n_timestamps * n - n_pairs AS n_absent, n_timestamps, n AS n_squares, round(total, 4) AS total, "
    "round((n_timestamps * n - n_pairs) / (n_timestamps * n), 9) AS absent_fraction FROM d, n",
)
def day_stats(spark: SparkSession, sf: str) -> DataFrame:
    spec = T.hourly_spec(spark, sf)
    out = Q.day_stats(T.events_raw(spark, sf), T.events_rollup(spark, sf, spec), spec)
    return rounded(out, 4, absent_fraction=9)


@query(
    "check_square_range",
    "SELECT user_id + 1 AS area, count(*) AS n_rows FROM events WHERE user_id + 1 > 100 OR user_id + 1 < 1 GROUP BY 1",
)
def check_square_range(spark: SparkSession, sf: str) -> DataFrame:
    # a 10 x 10 grid is declared, larger ids violate it
    return Q.check_square_range(T.events_raw(spark, sf), T.HOURLY.but(n_areas=100))


@query(
    "check_day_length",
    f"WITH {TEN} SELECT CAST(TIMESTAMP '2024-01-01' + to_minutes(10 * t_index) AS DATE) AS date, count(DISTINCT t_index) AS n_timestamps "
    "FROM ten GROUP BY 1 HAVING count(DISTINCT t_index) <> 144",
)
def check_day_length(spark: SparkSession, sf: str) -> DataFrame:
    rollup, spec = T.events_total_10min(spark, sf)
    return Q.check_day_length(rollup, spec)


@query(
    "expected_days",
    "SELECT CAST(d AS DATE) AS date, count(o_orderkey) AS n_orders FROM generate_series(DATE '1995-01-02', DATE '2001-11-04', INTERVAL 1 DAY) g(d) "
    "LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1",
)
def expected_days(spark: SparkSession, sf: str) -> DataFrame:
    orders = T.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    days = Q.expected_days(spark, T.DAILY)
    return days.join(orders, "date", "left").select("date", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query(
    "missing_days",
    "SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1995-01-02', DATE '2001-11-04', INTERVAL 1 DAY) g(d) "
    "WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)",
)
def missing_days(spark: SparkSession, sf: str) -> DataFrame:
    present = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return Q.missing_days(present, T.DAILY)


@query(
    "stack_days",
    f"WITH {TEN}, steps AS (SELECT unnest(range(0, 4320)) AS t_index) "
    "SELECT 1::BIGINT AS area, t_index, round(ten.value, 4) AS value, TIMESTAMP '2024-01-01' + to_minutes(10 * t_index) AS utc FROM steps LEFT JOIN ten USING (t_index)",
)
def stack_days(spark: SparkSession, sf: str) -> DataFrame:
    rollup, spec = T.events_total_10min(spark, sf)
    return rounded(P.stack_days(P.densify(rollup, spec), spec).select("area", "t_index", "value", "utc"), 4)


@query(
    "to_local",
    "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome' AS local FROM events",
)
def to_local(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "events").select("event_id", X.to_local("ts", "Europe/Rome").alias("local"))


@query(
    "grid_gaps",
    f"WITH {TEN} SELECT t_index FROM (SELECT unnest(range((SELECT min(t_index) FROM ten), (SELECT max(t_index) FROM ten) + 1)) AS t_index) "
    "WHERE t_index NOT IN (SELECT t_index FROM ten)",
)
def grid_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return Q.grid_gaps(T.events_total_10min(spark, sf)[0])


@query(
    "duplicate_times",
    "SELECT l_orderkey AS t_index, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_times(spark: SparkSession, sf: str) -> DataFrame:
    return Q.duplicate_times(T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("t_index")))


@query(
    "dst_check",
    f"WITH {TEN} SELECT CAST(TIMESTAMP '2024-01-01' + to_minutes(10 * t_index + 60) AS DATE) AS date, count(*) AS n_steps FROM ten GROUP BY 1 HAVING count(*) <> 144",
)
def dst_check(spark: SparkSession, sf: str) -> DataFrame:
    rollup, spec = T.events_total_10min(spark, sf)
    import datetime as dt

    rome = spec.but(tz="Europe/Rome", origin=dt.datetime(2024, 1, 1))
    return Q.dst_check(P.with_times(rollup.select("t_index"), rome), rome)


RUNS_SQL = (
    f"WITH {TEN}, miss AS (SELECT t_index FROM (SELECT unnest(range(0, 4320)) AS t_index) WHERE t_index NOT IN (SELECT t_index FROM ten)), "
    "runs AS (SELECT min(t_index) AS start, count(*) AS length FROM (SELECT t_index, t_index - row_number() OVER (ORDER BY t_index) AS g FROM miss) GROUP BY g)"
)


@query("gap_runs", f"{RUNS_SQL} SELECT start, length FROM runs")
def gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    rollup, spec = T.events_total_10min(spark, sf)
    return P.gap_runs(P.missing_steps(P.stack_days(P.densify(rollup, spec), spec)))


GAPS_SQL = (
    f"{RUNS_SQL}, fills AS (SELECT m.t_index, r.start, r.length, b.value AS v0, a.value AS v1 FROM miss m "
    "JOIN runs r ON m.t_index BETWEEN r.start AND r.start + r.length - 1 "
    "LEFT JOIN ten b ON b.t_index = r.start - 1 LEFT JOIN ten a ON a.t_index = r.start + r.length) "
)


@query(
    "interpolate_gaps",
    f"{GAPS_SQL} SELECT t_index, round(value, 4) AS value, false AS filled FROM ten UNION ALL "
    "SELECT t_index, CASE WHEN length <= 3 THEN round(v0 * (1.0 - (t_index - start + 1)::DOUBLE / (length + 1)) + v1 * ((t_index - start + 1)::DOUBLE / (length + 1)), 4) END, "
    "length <= 3 AND v0 IS NOT NULL AND v1 IS NOT NULL FROM fills",
)
def interpolate_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rollup, spec = T.events_total_10min(spark, sf)
    out = P.interpolate_gaps(P.stack_days(P.densify(rollup, spec), spec), spec)
    return rounded(out.select("t_index", "value", "filled"), 4)


@query(
    "gap_escalation",
    f"{GAPS_SQL} SELECT t_index, TIMESTAMP '2024-01-01' + to_minutes(10 * t_index) AS local FROM fills WHERE NOT (length <= 1 AND v0 IS NOT NULL AND v1 IS NOT NULL) "
    "AND t_index BETWEEN 2880 AND 3599",
)
def gap_escalation(spark: SparkSession, sf: str) -> DataFrame:
    rollup, spec = T.events_total_10min(spark, sf)
    strict = spec.but(max_gap=1)
    panel = P.interpolate_gaps(P.stack_days(P.densify(rollup, spec), spec), strict)
    return Q.gap_escalation(panel.filter("value is null"), strict)


@query(
    "null_audit",
    f"{GAPS_SQL} SELECT (SELECT count(*) FROM fills WHERE NOT (length <= 3 AND v0 IS NOT NULL AND v1 IS NOT NULL)) AS n_null, 4320::BIGINT AS n_cells",
)
def null_audit(spark: SparkSession, sf: str) -> DataFrame:
    rollup, spec = T.events_total_10min(spark, sf)
    return Q.null_audit(P.interpolate_gaps(P.stack_days(P.densify(rollup, spec), spec), spec))


def ten_areas(spark: SparkSession, sf: str):
    """Stacked and filled panel of ten cells; every 97th step of cell 3 is lost in that cell only."""
    rollup, spec = T.events_ten_areas(spark, sf)
    stacked = P.stack_days(P.densify(rollup, spec), spec)
    lost = (F.col("area") == 3) & (F.col("t_index") % 97 == 5)
    stacked = stacked.withColumn("value", F.when(~lost, F.col("value")))
    return stacked, P.interpolate_gaps(stacked, spec), spec


@query(
    "interpolate_gaps_areas",
    f"WITH {TENS} SELECT area, t_index, round(coalesce(value, line), 4) AS value, line IS NOT NULL AS filled FROM grid LEFT JOIN fills USING (area, t_index)",
)
def interpolate_gaps_areas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ten_areas(spark, sf)[1].select("area", "t_index", "value", "filled"), 4)


@query(
    "null_audit_areas",
    f"WITH {TENS} SELECT count(*) FILTER (WHERE value IS NULL AND line IS NULL) AS n_null, count(*) AS n_cells FROM grid LEFT JOIN fills USING (area, t_index)",
)
def null_audit_areas(spark: SparkSession, sf: str) -> DataFrame:
    return Q.null_audit(ten_areas(spark, sf)[1])


@query(
    "panel_report_areas",
    f"WITH {TENS} SELECT count(DISTINCT t_index) AS n_timestamps, count(DISTINCT area) AS n_areas, round(sum(value), 4) AS total, count(*) FILTER (WHERE value IS NULL) AS n_null, "
    "(SELECT count(*) FROM miss) AS n_missing_steps, (SELECT count(*) * 10 FROM seen) - (SELECT count(*) FROM obs) AS n_absent FROM grid",
)
def panel_report_areas(spark: SparkSession, sf: str) -> DataFrame:
    stacked, _, spec = ten_areas(spark, sf)
    report = Q.panel_report(stacked, T.events_ten_areas(spark, sf)[0], spec)
    return rounded(report.select("n_timestamps", "n_areas", "total", "n_null", "n_missing_steps", "n_absent"), 4)


@query(
    "panel_report_entries",
    f"WITH {TENS}, kinds AS (SELECT t_index, bool_or(line IS NOT NULL) AS closed FROM fills GROUP BY t_index) "
    "SELECT 'missing' AS kind, TIMESTAMP '2024-01-01' + to_minutes(10 * t_index) AS at FROM miss UNION ALL "
    "SELECT CASE WHEN closed THEN 'interpolated' ELSE 'unfilled' END, TIMESTAMP '2024-01-01' + to_minutes(10 * t_index) FROM kinds UNION ALL "
    "SELECT 'wrong_day', TIMESTAMP '2024-01-01' + to_days((t_index // 144)::INT) FROM (SELECT DISTINCT t_index, seen FROM grid) GROUP BY t_index // 144 HAVING count(*) FILTER (WHERE seen) <> 144",
)
def panel_report_entries(spark: SparkSession, sf: str) -> DataFrame:
    stacked, filled, spec = ten_areas(spark, sf)
    return Q.report_entries(stacked, filled, spec)


@query(
    "cell_totals",
    f"WITH {PANEL} SELECT area, round(sum(value), 4) AS total, round(avg(value), 9) AS mean FROM panel GROUP BY area",
)
def cell_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.cell_totals(T.events_panel(spark, sf)[0]), 4, mean=9)


@query(
    "panel_report",
    f"{RUNS_SQL} SELECT 4320::BIGINT AS n_timestamps, 1::BIGINT AS n_areas, TIMESTAMP '2024-01-01' AS first_utc, TIMESTAMP '2024-01-30 23:50:00' AS last_utc, "
    "TIMESTAMP '2024-01-01' AS first_local, TIMESTAMP '2024-01-30 23:50:00' AS last_local, (SELECT round(sum(value), 4) FROM ten) AS total, "
    "(SELECT count(*) FROM miss) AS n_null, (SELECT count(*) FROM miss) AS n_missing_steps, "
    "coalesce((SELECT string_agg(strftime(TIMESTAMP '2024-01-01' + to_minutes(10 * t_index), '%Y-%m-%d %H:%M:%S'), ',' ORDER BY t_index) FROM miss), '') AS missing_utc, 0::BIGINT AS n_absent",
)
def panel_report(spark: SparkSession, sf: str) -> DataFrame:
    rollup, spec = T.events_total_10min(spark, sf)
    out = Q.panel_report(P.stack_days(P.densify(rollup, spec), spec), rollup, spec)
    stamps = F.transform("missing_utc", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    return rounded(out, 4).withColumn("missing_utc", F.array_join(stamps, ","))


@query(
    "absent_by_split",
    f"WITH {PANEL}, d AS (SELECT CAST(local AS DATE) AS date, {SPLIT} AS split, count(*) FILTER (WHERE n_rows = 0) AS absent FROM panel "
    "WHERE t_index IN (SELECT t_index FROM obs) GROUP BY 1, 2) "
    "SELECT split, count(*) AS n_days, round(avg(absent), 6) AS mean_absent, max(absent) AS max_absent FROM d GROUP BY split",
)
def absent_by_split(spark: SparkSession, sf: str) -> DataFrame:
    spec = T.hourly_spec(spark, sf)
    days = Q.day_stats(T.events_raw(spark, sf), T.events_rollup(spark, sf, spec), spec)
    return rounded(Q.absent_by_split(days, spec))


@query(
    "reconcile_totals",
    "WITH a AS (SELECT CAST(ts AS DATE) AS date, sum(value) AS t FROM events GROUP BY 1), "
    "b AS (SELECT CAST(ts AS DATE) AS date, sum(CAST(value AS FLOAT)::DOUBLE) AS t FROM events WHERE event_type <> 'signup' OR day(ts) <> 5 GROUP BY 1) "
    "SELECT a.date, round(a.t, 4) AS total_a, round(b.t, 3) AS total_b, round(abs(a.t - b.t) / greatest(abs(a.t), abs(b.t), 1.0), 8) AS rel_diff, "
    "abs(a.t - b.t) / greatest(abs(a.t), abs(b.t), 1.0) <= 1e-6 AS agrees FROM a JOIN b USING (date)",
)
def reconcile_totals(spark: SparkSession, sf: str) -> DataFrame:
    # single precision against double precision; on the 5th one side also loses an event type
    ev = T.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    a = ev.groupBy("date").agg(F.sum("value").alias("total"))
    lossy = ev.filter((F.col("event_type") != "signup") | (F.dayofmonth("ts") != 5))
    b = lossy.groupBy("date").agg(F.sum(F.col("value").cast("float").cast("double")).alias("total"))
    return rounded(Q.reconcile_totals(a, b), 4, rel_diff=8, total_b=3)


LOG_SQL = (
    f"WITH {OBS}, n AS (SELECT max(user_id) + 1 AS n FROM events), d AS (SELECT CAST(TIMESTAMP '2024-01-01' + to_hours(t_index) AS DATE) AS date, "
    "CAST(sum(n_rows) AS BIGINT) AS raw_rows, count(DISTINCT t_index) * max(n) - count(*) AS absent_cells FROM obs, n GROUP BY 1), "
    "log AS (SELECT date, raw_rows, absent_cells, round(1 + raw_rows / 1000.0, 1)::DOUBLE AS download_s, round(0.5 + absent_cells / 1000.0, 1)::DOUBLE AS ingest_s, 100 + raw_rows % 50 AS peak_rss_mib FROM d)"
)


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """A run log whose figures follow from the day statistics."""
    spec = T.hourly_spec(spark, sf)
    days = Q.day_stats(T.events_raw(spark, sf), T.events_rollup(spark, sf, spec), spec)
    return days.select(
        "date",
        F.col("n_raw_rows").alias("raw_rows"),
        F.col("n_absent").alias("absent_cells"),
        F.round(1 + F.col("n_raw_rows") / F.lit(1000.0), 1).alias("download_s"),
        F.round(F.lit(0.5) + F.col("n_absent") / F.lit(1000.0), 1).alias("ingest_s"),
        (100 + F.col("n_raw_rows") % 50).alias("peak_rss_mib"),
    )


@query(
    "ingest_summary",
    f"{LOG_SQL} SELECT count(*) AS n_days, min(date) AS first_day, max(date) AS last_day, CAST(sum(raw_rows) AS BIGINT) AS total_raw_rows, "
    "round(sum(download_s) / 60, 6) AS download_total_min, round(avg(download_s), 6) AS download_mean_s, round(stddev_samp(download_s), 6) AS download_std_s, "
    "round(sum(ingest_s) / 60, 6) AS ingest_total_min, round(avg(ingest_s), 6) AS ingest_mean_s, round(stddev_samp(ingest_s), 6) AS ingest_std_s, "
    "max(peak_rss_mib) AS peak_rss_max_mib, round(avg(peak_rss_mib), 6) AS peak_rss_mean_mib, CAST(sum(absent_cells) AS BIGINT) AS absent_total, "
    "round(avg(absent_cells), 6) AS absent_mean_per_day, max(absent_cells) AS absent_max_per_day, "
    "(SELECT date FROM log ORDER BY absent_cells DESC, date LIMIT 1) AS absent_max_day FROM log",
)
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.ingest_summary(run_log(spark, sf)))


@query(
    "benchmark_summary",
    "WITH runs AS (SELECT l_returnflag || l_linestatus AS strategy, l_extendedprice AS peak, l_quantity AS wall_s FROM lineitem) "
    "SELECT strategy, count(*) AS n_runs, round(avg(peak), 4) AS mean_peak, round(avg(wall_s), 6) AS mean_wall_s, "
    "round((SELECT avg(peak) FROM runs WHERE strategy = 'NO') / avg(peak), 8) AS baseline_over_peak FROM runs GROUP BY 1",
)
def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    runs = T.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("strategy"),
        F.col("l_extendedprice").alias("peak"),
        F.col("l_quantity").alias("wall_s"),
    )
    return rounded(Q.benchmark_summary(runs, "NO"), 6, mean_peak=4, baseline_over_peak=8)
