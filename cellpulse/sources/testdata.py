"""Adapters from the star-schema test tables to call-record shapes.

``events``: a user is a cell, an event type is a country code, ``value`` is the activity.
``lineitem``: a supplier is a cell, a ship date is a day, revenue is the activity.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators import panel as P
from cellpulse.settings import PanelSpec, SplitRange

# The codes given to the event types of the test table.
COUNTRY_OF_EVENT = {"click": 39, "error": 33, "purchase": 44, "signup": 49, "view": 1}

EVENT_HOLIDAYS = (
    (dt.date(2024, 1, 1), "Capodanno (New Year's Day)", "national", ""),
    (dt.date(2024, 1, 6), "Epifania (Epiphany)", "national", ""),
    (dt.date(2024, 1, 24), "Local observance", "observance", ""),
)

HOURLY = PanelSpec(
    start=dt.date(2024, 1, 1),
    end=dt.date(2024, 1, 30),
    step_seconds=3600,
    daily=24,
    weekly=168,
    n_areas=1,
    splits=(
        SplitRange("train", dt.date(2024, 1, 1), dt.date(2024, 1, 16)),
        SplitRange("validation", dt.date(2024, 1, 17), dt.date(2024, 1, 20)),
        SplitRange("test", dt.date(2024, 1, 21), dt.date(2024, 1, 25)),
        SplitRange("stress", dt.date(2024, 1, 26), dt.date(2024, 1, 30)),
    ),
    fixed_areas=(5, 2),
    lags=(1, 2, 3, 6, 12, 24, 25, 48, 168),
    rolling=(3, 6, 24),
    holidays=EVENT_HOLIDAYS,
)

DAILY = PanelSpec(
    start=dt.date(1995, 1, 2), end=dt.date(2001, 11, 4), step_seconds=86_400, daily=1, weekly=7, n_areas=1
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-record form of ``events``: ``square_id, time_ms, country_code, internet``."""
    code = F.create_map(*[F.lit(x) for pair in COUNTRY_OF_EVENT.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") + 1).alias("square_id"),
        (X.epoch_seconds("ts") * 1000).alias("time_ms"),
        code[F.col("event_type")].alias("country_code"),
        F.col("value").alias("internet"),
    )


def hourly_spec(spark: SparkSession, sf_dir: str) -> PanelSpec:
    """The hourly geometry with one area per user id; a single number is read from the table."""
    top = table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]
    return HOURLY.but(n_areas=int(top) + 1)


def events_rollup(spark: SparkSession, sf_dir: str, spec: PanelSpec = HOURLY) -> DataFrame:
    return P.country_rollup(events_raw(spark, sf_dir), spec)


def events_panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """All users at all 720 hours, silence 0.0."""
    spec = hourly_spec(spark, sf_dir)
    return P.full_panel(events_rollup(spark, sf_dir, spec), spec), spec


def exact_totals(panel: DataFrame) -> DataFrame:
    """``cell_totals`` of a panel as a ranking needs them: equal totals share a value, however a cell's records lay and in whatever order tasks added them.

    Summed as decimals of six digits; the events hold two.
    """
    totals = P.cell_totals(panel.withColumn("value", F.col("value").cast("decimal(18,6)")))
    return totals.select("area", *[F.col(c).cast("double").alias(c) for c in ("total", "mean")])


def events_total_10min(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """All users summed per 10-minute step, as one cell with id 1; steps without events are missing."""
    spec = HOURLY.but(step_seconds=600, daily=144, weekly=1008, n_areas=1)
    raw = events_raw(spark, sf_dir).withColumn("square_id", F.lit(1).cast("long"))
    return P.country_rollup(raw, spec), spec


def events_ten_areas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """The users dealt over ten cells, summed per 10-minute step: many silent cells and some missing steps."""
    spec = HOURLY.but(step_seconds=600, daily=144, weekly=1008, n_areas=10)
    raw = events_raw(spark, sf_dir).withColumn("square_id", (F.col("square_id") - 1) % 10 + 1)
    return P.country_rollup(raw, spec), spec


def supplier_daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """Daily revenue per supplier over the whole shipping period, silent days 0.0."""
    items = table(spark, sf_dir, "lineitem")
    top = items.agg(F.max("l_suppkey")).first()[0]
    spec = DAILY.but(n_areas=int(top) + 1)
    obs = (
        items.select(
            (F.col("l_suppkey") + 1).alias("area"),
            X.step_index("l_shipdate", spec).alias("t_index"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"),
        )
        .groupBy("area", "t_index")
        .agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("n_rows"))
    )
    return P.full_panel(obs, spec), spec


def customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per customer as ``(area, total)``.

    Summed as decimals: a sum of doubles depends on the order in which tasks add, and equal totals would be ranked by that noise.
    """
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("area"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,6)")).cast("double").alias("total"))
    )


def customer_totals_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer_totals`` as SQL sums doubles: each customer's orders are added one by one in order of their key, which is the order of the table.

    Totals that are equal as decimals may then differ in their last bit, and SQL ranks them by it. The addition is a running window, so a
    customer with very many orders spills instead of filling a task's memory.
    """
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice").rowsBetween(Window.unboundedPreceding, 0)
    added = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("area"), F.sum("o_totalprice").over(w).alias("_sum"), F.count(F.lit(1)).over(w).alias("_at")
    )
    return added.groupBy("area").agg(F.max_by("_sum", "_at").alias("total"))
