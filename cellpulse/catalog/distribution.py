"""Distribution, area selection and spatial queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.catalog.registry import CUSTOMERS, PANEL, TOTALS, query, r, rounded
from cellpulse.functions import exprs as X
from cellpulse.operators import distribution as D
from cellpulse.operators import panel as P
from cellpulse.operators import spatial as S
from cellpulse.plans.ordering import globally_ordered
from cellpulse.sources import testdata as T

STATS = (
    "n AS (SELECT count(*) AS n, sum(total) AS s, avg(total) AS m, stddev_pop(total) AS sd FROM cells), "
    "o AS (SELECT area, total, row_number() OVER (ORDER BY total, area) AS i FROM cells)"
)
LOGS = "logs AS (SELECT ln(total) AS x FROM cells WHERE total > 0)"
GINI = "sum((2 * i - n - 1) * total) / (max(n) * max(s))"


def top_sql(f: float) -> str:
    return f"sum(CASE WHEN n - i + 1 <= greatest(1, round_even(n * {f}, 0)) THEN total ELSE 0 END) / max(s)"


@query(
    "distribution_stats",
    f"WITH {CUSTOMERS}, {STATS}, {LOGS}, "
    "mo AS (SELECT count(*) AS n_cells, round(sum(total), 2) AS total, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS std, round(min(total), 4) AS minimum, round(max(total), 4) AS maximum, "
    "round(avg(power((total - m) / sd, 3)), 6) AS skewness, round(avg(power((total - m) / sd, 4)) - 3, 6) AS kurtosis, count(*) FILTER (WHERE total = 0) AS n_zero_cells, "
    "round(quantile_cont(total, 0.5), 4) AS median, round(max(total) / quantile_cont(total, 0.5), 8) AS max_over_median FROM cells, n), "
    f"g AS (SELECT round({GINI}, 8) AS gini, round({top_sql(0.01)}, 8) AS top_1pct_share, round({top_sql(0.05)}, 8) AS top_5pct_share, round({top_sql(0.10)}, 8) AS top_10pct_share, "
    "round(sum(CASE WHEN i <= n // 2 THEN total ELSE 0 END) / max(s), 8) AS bottom_50pct_share FROM o, n), "
    "l AS (SELECT count(*) AS n_positive, round(avg(x), 8) AS lognormal_mu, round(stddev_pop(x), 8) AS lognormal_sigma FROM logs) "
    "SELECT * FROM mo, g, l",
)
def distribution_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = D.distribution_stats(T.customer_totals(spark, sf))
    eight = dict.fromkeys(
        ("gini", "top_1pct_share", "top_5pct_share", "top_10pct_share", "bottom_50pct_share", "lognormal_mu", "lognormal_sigma", "max_over_median"), 8
    )
    return rounded(out, 6, total=2, minimum=4, maximum=4, median=4, **eight)


@query("gini", f"WITH {CUSTOMERS}, {STATS} SELECT round({GINI}, 8) AS gini FROM o, n")
def gini(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.gini(globally_ordered(T.customer_totals(spark, sf), "total", "area")), 8)


@query(
    "top_share",
    f"WITH {TOTALS}, cells AS (SELECT area, total FROM totals), {STATS} SELECT round({top_sql(0.01)}, 8) AS top_1pct_share, round({top_sql(0.05)}, 8) AS top_5pct_share, round({top_sql(0.10)}, 8) AS top_10pct_share FROM o, n",
)
def top_share(spark: SparkSession, sf: str) -> DataFrame:
    totals = P.cell_totals(T.events_panel(spark, sf)[0])
    return rounded(D.top_share(globally_ordered(totals, "total", "area")), 8)


@query(
    "bottom_half_share",
    f"WITH {TOTALS}, cells AS (SELECT area, total FROM totals), {STATS} SELECT round(sum(CASE WHEN i <= n // 2 THEN total ELSE 0 END) / max(s), 8) AS bottom_50pct_share FROM o, n",
)
def bottom_half_share(spark: SparkSession, sf: str) -> DataFrame:
    totals = P.cell_totals(T.events_panel(spark, sf)[0])
    return rounded(D.bottom_half_share(globally_ordered(totals, "total", "area")), 8)


@query(
    "lognormal_fit",
    f"WITH {CUSTOMERS}, {LOGS} SELECT count(*) AS n_positive, round(avg(x), 8) AS lognormal_mu, round(stddev_pop(x), 8) AS lognormal_sigma FROM logs",
)
def lognormal_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.lognormal_fit(T.customer_totals(spark, sf)), 8)


@query(
    "lognormal_ks",
    f"WITH {CUSTOMERS}, l AS (SELECT area, ln(total) AS x FROM cells WHERE total > 0), f AS (SELECT avg(x) AS mu, stddev_pop(x) AS sg, count(*) AS n FROM l), "
    "z AS (SELECT area, (x - mu) / sg AS z, row_number() OVER (ORDER BY x, area) AS i, n FROM l, f), k AS (SELECT unnest(range(0, 160)) AS k), "
    "p AS (SELECT area, max(i) AS i, max(n) AS n, 0.5 + sign(max(z)) * sum(exp(-z * z / 2 + (2 * k + 1) * ln(abs(z)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))) / sqrt(2 * pi()) AS f FROM z, k GROUP BY area), "
    "d AS (SELECT max(greatest(i / n - f, f - (i - 1) / n)) AS d, max(n) AS n FROM p), a AS (SELECT d, d * sqrt(n) + 1 / (6 * sqrt(n)) + (d * sqrt(n) - 1) / (4 * n) AS x FROM d) "
    "SELECT round(max(d), 8) AS lognormal_ks_stat, round(CASE WHEN max(x) < 0.18 THEN 1.0 ELSE least(1.0, greatest(0.0, sum(CASE WHEN k = 0 THEN 0 WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * x * x)))) END, 8) + 0.0 AS lognormal_ks_pvalue FROM a, k",
)
def lognormal_ks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.lognormal_ks(T.customer_totals(spark, sf)), 8)


@query(
    "log_histogram",
    f"WITH {CUSTOMERS}, x AS (SELECT log10(total) AS x FROM cells WHERE total > 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x), "
    "b AS (SELECT least(60, floor((x - lo) / (hi - lo) * 60) + 1)::INTEGER AS bin, lo, hi FROM x, e) "
    "SELECT bin, count(*) AS n, round(power(10.0, max(lo) + (bin - 1) * (max(hi) - max(lo)) / 60), 4) AS lower, round(power(10.0, max(lo) + bin * (max(hi) - max(lo)) / 60), 4) AS upper FROM b GROUP BY bin",
)
def log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.log_histogram(T.customer_totals(spark, sf)), 4)


@query(
    "ccdf",
    f"WITH {CUSTOMERS} SELECT area, round(total, 4) AS total, row_number() OVER (ORDER BY total DESC, area) AS position, round(row_number() OVER (ORDER BY total DESC, area) / count(*) OVER (), 9) AS ccdf FROM cells",
)
def ccdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.ccdf(T.customer_totals_by_key(spark, sf)), 4, ccdf=9)


@query(
    "top_areas",
    f"WITH {TOTALS} SELECT area, round(total, 4) AS total, row_number() OVER (ORDER BY total DESC, area)::INTEGER AS position FROM totals ORDER BY total DESC, area LIMIT 3",
)
def top_areas(spark: SparkSession, sf: str) -> DataFrame:
    totals = T.exact_totals(T.events_panel(spark, sf)[0])
    return rounded(D.top_areas(totals).select("area", "total", "position"), 4)


@query(
    "select_areas",
    f"WITH {TOTALS}, k AS (SELECT area, total, row_number() OVER (ORDER BY total DESC, area) AS p FROM totals), "
    "w AS (SELECT area, total, p FROM k WHERE p <= 3 OR area IN (5, 2)) "
    "SELECT (SELECT area FROM k WHERE p = 1) AS top_traffic, (SELECT string_agg(area::VARCHAR, ',' ORDER BY p) FROM k WHERE p <= 3) AS top_three, '5,2' AS fixed, "
    "(SELECT string_agg(area || '=' || p, ',' ORDER BY area) FROM w) AS ranks, (SELECT round(sum(total), 4) FROM w) AS named_total",
)
def select_areas(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    out = D.select_areas(T.exact_totals(panel), spec)
    pairs = F.transform(
        F.array_sort(F.transform(F.map_entries("ranks"), lambda e: F.struct(e["key"].cast("long").alias("k"), e["value"].alias("v")))),
        lambda e: F.concat(e["k"].cast("string"), F.lit("="), e["v"].cast("string")),
    )
    return out.select(
        "top_traffic",
        F.array_join(F.col("top_three").cast("array<string>"), ",").alias("top_three"),
        F.array_join(F.col("fixed").cast("array<string>"), ",").alias("fixed"),
        F.array_join(pairs, ",").alias("ranks"),
        r(F.aggregate(F.map_values("totals"), F.lit(0.0), lambda a, x: a + x), 4).alias("named_total"),
    )


@query(
    "rank_of_cell",
    "WITH cells AS (SELECT c_custkey AS area, count(o_orderkey)::DOUBLE AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) "
    "SELECT area, total, rank() OVER (ORDER BY total DESC) AS rank, row_number() OVER (ORDER BY total DESC, area) AS position FROM cells",
)
def rank_of_cell(spark: SparkSession, sf: str) -> DataFrame:
    # order counts: almost every rank is a tie
    counts = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    cells = T.table(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    totals = cells.select(F.col("c_custkey").alias("area"), F.coalesce("n", F.lit(0)).cast("double").alias("total"))
    return D.ranked_cells(totals)


@query(
    "plotted_areas",
    f"WITH {TOTALS}, k AS (SELECT area, row_number() OVER (ORDER BY total DESC, area) AS pos FROM totals) "
    "SELECT area, min(pos) AS pos FROM (SELECT area, pos FROM k WHERE pos <= 3 UNION ALL SELECT * FROM (VALUES (5::BIGINT, 4::BIGINT), (2::BIGINT, 5::BIGINT)) v(area, pos)) GROUP BY area",
)
def plotted_areas(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return D.plotted_areas(T.exact_totals(panel), spec)


@query(
    "extract_series",
    f"WITH {PANEL} SELECT t_index, utc, local, round(max(CASE WHEN area = 7 THEN value END), 4) AS square_7, round(max(CASE WHEN area = 2 THEN value END), 4) AS square_2, round(max(CASE WHEN area = 11 THEN value END), 4) AS square_11 FROM panel GROUP BY 1, 2, 3",
)
def extract_series(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(D.extract_series(panel, [7, 2, 11], spec), 4)


@query(
    "date_window",
    f"WITH {PANEL} SELECT area, t_index, local, round(value, 4) AS value FROM panel WHERE CAST(local AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'",
)
def date_window(spark: SparkSession, sf: str) -> DataFrame:
    panel, _ = T.events_panel(spark, sf)
    return rounded(P.date_window(panel, dt.date(2024, 1, 8), 7).select("area", "t_index", "local", "value"), 4)


@query(
    "normalise_by_peak",
    f"WITH {PANEL} SELECT area, t_index, round(CASE WHEN max(value) OVER (PARTITION BY area) > 0 THEN value / max(value) OVER (PARTITION BY area) ELSE value END, 9) AS normalised FROM panel",
)
def normalise_by_peak(spark: SparkSession, sf: str) -> DataFrame:
    panel, _ = T.events_panel(spark, sf)
    return rounded(D.normalise_by_peak(panel).select("area", "t_index", "normalised"), 9)


@query(
    "area_summary",
    f"WITH {PANEL}, s AS (SELECT area, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.01) AS trough, "
    "quantile_cont(value, 0.5) FILTER (WHERE hour(local) BETWEEN 2 AND 4) AS night, avg(value) FILTER (WHERE isodow(local) < 6) AS wd, avg(value) FILTER (WHERE isodow(local) >= 6) AS we, count(*) FILTER (WHERE value = 0) AS n_zero FROM panel GROUP BY area) "
    "SELECT area, round(mean, 8) AS mean, round(median, 8) AS median, round(std, 8) AS std, round(std / nullif(mean, 0), 8) AS cv, round(mn, 8) AS min, round(mx, 4) AS max, "
    "CASE WHEN trough <> 0 THEN round(mx / nullif(trough, 0), 6) ELSE 'inf'::DOUBLE END AS peak_to_trough, round(night, 8) AS night_floor, round(night / nullif(mean, 0), 8) AS night_floor_over_mean, round(wd, 8) AS weekday_mean, round(we, 8) AS weekend_mean, round(we / nullif(wd, 0), 8) AS weekend_over_weekday, n_zero FROM s",
)
def area_summary(spark: SparkSession, sf: str) -> DataFrame:
    panel, _ = T.events_panel(spark, sf)
    return rounded(D.area_summary(panel), 8, max=4, peak_to_trough=6)


@query(
    "daily_mean_std_corr",
    f"WITH {PANEL}, d AS (SELECT area, CAST(local AS DATE) AS date, avg(value) AS m, stddev_pop(value) AS s, avg(ln(1 + value)) AS ml, stddev_pop(ln(1 + value)) AS sl FROM panel GROUP BY 1, 2) "
    "SELECT area, round(corr(m, s), 7) AS corr_raw, round(corr(ml, sl), 7) AS corr_log1p FROM d GROUP BY area",
)
def daily_mean_std_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.daily_mean_std_corr(T.events_panel(spark, sf)[0]), 7)


@query(
    "busiest_day",
    f"WITH {PANEL}, d AS (SELECT area, CAST(local AS DATE) AS date, sum(value) AS total FROM panel GROUP BY 1, 2) "
    "SELECT area, date, round(total, 4) AS total FROM d QUALIFY row_number() OVER (PARTITION BY area ORDER BY round(total, 6) DESC, date) = 1",
)
def busiest_day(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.busiest_day(T.events_panel(spark, sf)[0]), 4)


# --- spatial -------------------------------------------------------------------------------------

# synthetic position of a cell: rows go north, columns east, from a corner of the city
LAT0, LON0, STEP = 45.40, 9.05, 0.002
CELLS = (
    "cells AS (SELECT s_suppkey + 1 AS area, s_suppkey // 10 AS grid_row, s_suppkey % 10 AS grid_col FROM supplier), "
    f"pos AS (SELECT area, {LAT0} + {STEP} * grid_row AS latitude, {LON0} + {STEP} * grid_col * 10 AS longitude FROM cells)"
)


def supplier_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = T.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("area"))
    return S.grid_position(cells, T.HOURLY.but(grid_side=10))


def supplier_positions(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_cells(spark, sf).select(
        "area",
        (F.lit(LAT0) + F.lit(STEP) * F.col("grid_row")).alias("latitude"),
        (F.lit(LON0) + F.lit(STEP) * F.col("grid_col") * 10).alias("longitude"),
    )


def landmarks_sql() -> str:
    rows = ", ".join("('{}', {}, {}, '{}')".format(*row) for row in S.LANDMARKS)
    return f"lm AS (SELECT * FROM (VALUES {rows}) v(name, la, lo, kind))"


DIST = (
    "2 * 6371000.0 * asin(sqrt(power(sin(radians(la - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(la)) * power(sin(radians(lo - longitude) / 2), 2)))"
)
NEAR = f"WITH {CELLS}, {landmarks_sql()}, d AS (SELECT area, latitude, longitude, name, kind, {DIST} AS metres FROM pos, lm), near AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY metres, name) AS k FROM d)"


@query("grid_position", f"WITH {CELLS} SELECT area, grid_row, grid_col, area BETWEEN 1 AND 100 AS in_grid FROM cells")
def grid_position(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_cells(spark, sf)


@query(
    "totals_grid",
    f"WITH {TOTALS} SELECT (area - 1) // 100 AS grid_row, "
    + ", ".join(f'round(sum(CASE WHEN (area - 1) % 100 = {c} THEN total END), 4) AS "{c}"' for c in range(100))
    + " FROM totals GROUP BY 1",
)
def totals_grid(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(S.totals_grid(P.cell_totals(panel), spec), 4)


@query(
    "haversine",
    f"WITH {CELLS} SELECT a.area, round(2 * 6371000.0 * asin(sqrt(power(sin(radians(45.4642 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(45.4642)) * power(sin(radians(9.19 - longitude) / 2), 2))), 4) AS metres FROM pos a",
)
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    d = X.haversine(F.col("latitude"), F.col("longitude"), F.lit(45.4642), F.lit(9.19))
    return supplier_positions(spark, sf).select("area", r(d, 4).alias("metres"))


@query("nearest_landmarks", f"{NEAR} SELECT area, k::INTEGER AS nearest_rank, name, kind, round(metres, 4) AS metres FROM near WHERE k <= 3")
def nearest_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.nearest_landmarks(supplier_positions(spark, sf)), 4)


@query(
    "describe_cell",
    f"{NEAR} SELECT area, round(max(latitude), 5)::DOUBLE AS latitude, round(max(longitude), 5)::DOUBLE AS longitude, max(CASE WHEN k = 1 THEN name END) AS nearest, CAST(round(max(CASE WHEN k = 1 THEN metres END)) AS BIGINT) AS nearest_m, "
    "max(CASE WHEN k = 1 THEN kind END) AS nearest_kind, string_agg(name || ' ' || CAST(CAST(round(metres) AS BIGINT) AS VARCHAR) || ' m', '; ' ORDER BY k) AS context FROM near WHERE k <= 3 GROUP BY area",
)
def describe_cell(spark: SparkSession, sf: str) -> DataFrame:
    return S.describe_cell(supplier_positions(spark, sf))
