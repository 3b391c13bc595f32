"""Split, scaling and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.catalog.registry import LABELLED, PANEL, query, r, rounded
from cellpulse.operators import features as FE
from cellpulse.sources import testdata as T

W = "OVER (PARTITION BY area ORDER BY t_index"


def labelled(spark: SparkSession, sf: str):
    panel, spec = T.events_panel(spark, sf)
    return FE.assign_split(panel.drop("utc", "n_rows"), spec), spec


@query("assign_split", f"WITH {LABELLED} SELECT area, t_index, local, split FROM lab")
def assign_split(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf)[0].select("area", "t_index", "local", "split")


@query(
    "check_splits",
    f"WITH {LABELLED}, s AS (SELECT split, count(DISTINCT t_index) AS n_steps, min(t_index) AS first_index, max(t_index) AS last_index FROM lab GROUP BY split), "
    "e AS (SELECT *, CASE split WHEN 'train' THEN 384 WHEN 'validation' THEN 96 ELSE 120 END AS expected_steps FROM s) "
    "SELECT split, n_steps, first_index, last_index, expected_steps::BIGINT AS expected_steps, n_steps = expected_steps AS complete, coalesce(first_index = lag(last_index) OVER (ORDER BY first_index) + 1, true) AS contiguous FROM e",
)
def check_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows, spec = labelled(spark, sf)
    return FE.check_splits(rows, spec)


@query("fit_rows", f"WITH {LABELLED} SELECT area, split, count(*) AS n, round(sum(value), 4) AS total FROM lab WHERE split IN ('train', 'validation') GROUP BY 1, 2")
def fit_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = FE.fit_rows(labelled(spark, sf)[0])
    return rounded(rows.groupBy("area", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


STATS = f"{LABELLED}, st AS (SELECT area, avg(ln(1 + value)) AS log_mean, stddev_pop(ln(1 + value)) AS log_std, count(*) AS n_fitted FROM lab WHERE split = 'train' GROUP BY area)"


def train_stats(rows: DataFrame) -> DataFrame:
    return FE.scaler_fit(rows.filter("split = 'train'"))


@query("scaler_fit", f"WITH {STATS} SELECT area, round(log_mean, 9) AS log_mean, round(log_std, 9) AS log_std, n_fitted FROM st")
def scaler_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(train_stats(labelled(spark, sf)[0]), 9)


@query("scaler_transform", f"WITH {STATS} SELECT lab.area, t_index, round((ln(1 + value) - log_mean) / nullif(log_std, 0), 7) + 0.0 AS scaled FROM lab JOIN st ON st.area = lab.area")
def scaler_transform(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = labelled(spark, sf)
    return rounded(FE.scaler_transform(rows, train_stats(rows)).select("area", "t_index", "scaled"), 7)


@query(
    "scaler_inverse",
    f"WITH {STATS}, z AS (SELECT lab.area, t_index, (ln(1 + value) - log_mean) / nullif(log_std, 0) - 0.5 AS z, log_mean, log_std FROM lab JOIN st ON st.area = lab.area) "
    "SELECT area, t_index, round(greatest(0, exp(z * log_std + log_mean) - 1), 6) + 0.0 AS value FROM z",
)
def scaler_inverse(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = labelled(spark, sf)
    stats = train_stats(rows)
    shifted = FE.scaler_transform(rows, stats).withColumn("scaled", F.col("scaled") - 0.5).drop("value")
    return rounded(FE.scaler_inverse(shifted, stats).select("area", "t_index", "value"), 6)


CAL = (
    "round(sin(2 * pi() * (hour(local) * 60 + minute(local)) / 1440), 9) + 0.0 AS sin_minute_of_day, round(cos(2 * pi() * (hour(local) * 60 + minute(local)) / 1440), 9) + 0.0 AS cos_minute_of_day, "
    "round(sin(2 * pi() * (isodow(local) - 1) / 7), 9) + 0.0 AS sin_day_of_week, round(cos(2 * pi() * (isodow(local) - 1) / 7), 9) + 0.0 AS cos_day_of_week, "
    "CASE WHEN isodow(local) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend, "
    "CASE WHEN CAST(local AS DATE) IN (DATE '2024-01-01', DATE '2024-01-06', DATE '2024-01-24') THEN 1.0 ELSE 0.0 END::DOUBLE AS is_holiday"
)


@query("calendar_features", f"WITH {PANEL} SELECT area, t_index, {CAL} FROM panel")
def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(FE.calendar_features(panel.select("area", "t_index", "local"), spec).drop("local"), 9)


LAGS = ", ".join(f"round(lag(value, {k}) {W}), 4) AS lag_{k}" for k in T.HOURLY.lags)
ROLL = ", ".join(
    f"round(avg(value) {W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 7) + 0.0 AS roll_mean_{n}, round(stddev_pop(value) {W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) + 0.0 AS roll_std_{n}"
    for n in T.HOURLY.rolling
)
STDS = {f"roll_std_{n}": 6 for n in T.HOURLY.rolling}
MEANS = {f"roll_mean_{n}": 7 for n in T.HOURLY.rolling}


@query("lag_features", f"WITH {PANEL} SELECT area, t_index, {LAGS} FROM panel")
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(FE.lag_features(panel.select("area", "t_index", "value"), spec).drop("value"), 4)


@query("rolling_features", f"WITH {PANEL} SELECT area, t_index, {ROLL} FROM panel")
def rolling_features(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    return rounded(FE.rolling_features(panel.select("area", "t_index", "value"), spec).drop("value"), 7, **STDS)


@query("design_matrix", f"WITH {PANEL} SELECT area, t_index, round(value, 4) AS value, {LAGS}, {ROLL}, {CAL} FROM panel QUALIFY t_index >= 168")
def design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    design = FE.design_matrix(panel.select("area", "t_index", "local", "value"), spec).drop("local")
    nine = dict.fromkeys(["sin_minute_of_day", "cos_minute_of_day", "sin_day_of_week", "cos_day_of_week"], 9)
    return rounded(design, 4, **STDS, **MEANS, **nine)


@query(
    "sliding_windows",
    f"WITH {PANEL}, w AS (SELECT area, t_index, value, array_agg(value) {W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS win FROM panel) "
    "SELECT area, t_index, round(value, 4) AS target, len(win) AS n, round(win[1], 4) AS oldest, round(win[24], 4) AS newest, round(list_sum(list_transform(win, lambda x, i: x * i)), 3) AS weighted FROM w WHERE len(win) = 24",
)
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    panel, _ = T.events_panel(spark, sf)
    rows = FE.sliding_windows(panel.select("area", "t_index", "value"), 24)
    weighted = F.aggregate(F.transform("window", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "area",
        "t_index",
        r("value", 4).alias("target"),
        F.size("window").cast("long").alias("n"),
        r(F.element_at("window", 1), 4).alias("oldest"),
        r(F.element_at("window", -1), 4).alias("newest"),
        r(weighted, 3).alias("weighted"),
    )


@query(
    "window_exog",
    f"WITH {PANEL}, c AS (SELECT area, t_index, {CAL} FROM panel) SELECT area, t_index, 24::INTEGER AS n, round(24 * sin_minute_of_day, 6) + 0.0 AS along, is_weekend AS weekend FROM c WHERE t_index >= 24",
)
def window_exog(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    rows = FE.calendar_features(FE.sliding_windows(panel.select("area", "t_index", "local", "value"), 24), spec)
    names = ["sin_minute_of_day", "cos_minute_of_day", "is_weekend"]
    out = FE.window_exog(rows, names)
    along = F.aggregate("exog", F.lit(0.0), lambda a, e: a + F.round(e["sin_minute_of_day"], 9))
    return out.select("area", "t_index", F.size("exog").alias("n"), r(along, 6).alias("along"), F.element_at("exog", -1)["is_weekend"].alias("weekend"))


FOURIER = {24: 3, 168: 2}


@query(
    "fourier_terms",
    f"WITH {PANEL} SELECT area, t_index, "
    + ", ".join(
        f"round(sin(2 * pi() * {k} * t_index / {p}), 8) + 0.0 AS sin_{p}_{k}, round(cos(2 * pi() * {k} * t_index / {p}), 8) + 0.0 AS cos_{p}_{k}"
        for p, top in FOURIER.items()
        for k in range(1, top + 1)
    )
    + " FROM panel",
)
def fourier_terms(spark: SparkSession, sf: str) -> DataFrame:
    panel, _ = T.events_panel(spark, sf)
    return rounded(FE.fourier_terms(panel.select("area", "t_index"), FOURIER), 8)


@query("causality_audit", f"WITH {PANEL} SELECT count(*) AS n_moved FROM panel WHERE false")
def causality_audit(spark: SparkSession, sf: str) -> DataFrame:
    panel, spec = T.events_panel(spark, sf)
    moved = FE.causality_audit(panel.select("area", "t_index", "local", "value"), spec, cut=500)
    return moved.agg(F.count(F.lit(1)).alias("n_moved"))
