"""Exact global order over any number of rows.

A window without ``partitionBy`` sorts everything in one task. Instead a bounded random set of rows
is taken as split points, every row finds its bucket among them, and each bucket is sorted on its
own. Bucket counts and sums (one row per bucket) give the offsets. The order key ends with a unique
column, so equal values spread over buckets like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.plans.storage import durable

MIN_BUCKETS = 16
MAX_BUCKETS = 4_096


def _bucket_count(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKETS, min(MAX_BUCKETS, 2 * parts))


def _bucket_of(key: Column, points: list[tuple[float, int]]) -> Column:
    """How many split points lie below ``key``; a binary search over a literal array."""
    if not points:
        return F.lit(0)
    bounds = F.array(*[_key(F.lit(float(v)), F.lit(int(u))) for v, u in points])
    widths, width = [], 1
    while width <= len(points):
        widths.append(width)
        width *= 2
    steps = F.array(*[F.lit(w) for w in reversed(widths)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, w: F.when(F.get(bounds, low + w - 1) < key, low + w).otherwise(low),
    )


def _key(value: Column, unique: Column) -> Column:
    return F.struct(value.cast("double").alias("v"), unique.cast("long").alias("u"))


def globally_ordered(
    df: DataFrame, value: str, unique: str, *, descending: bool = False, stored: bool = False, ties: bool = False
) -> DataFrame:
    """Add ``position`` (1..n), ``running`` (sum of ``value`` up to and including the row) and
    ``n_rows`` / ``grand_total``; with ``ties`` also ``rank``, where equal values share a position.

    Rows with a NULL value have no place in the order and are left out. ``stored`` says that ``df``
    is already a written table; otherwise it is written once, because three passes read it.
    """
    table = df.filter(F.col(value).isNotNull())
    if not stored:
        table = durable(table, "ordered")
    sign = -1.0 if descending else 1.0
    table = table.withColumn("_v", F.col(value).cast("double") * F.lit(sign))
    # A bounded set: as many rows as there are buckets, chosen by hash.
    picked = table.select("_v", unique).orderBy(F.xxhash64(unique), unique).limit(_bucket_count(table) - 1).collect()
    points = sorted((row["_v"], row[unique]) for row in picked)
    rows = table.withColumn("_bucket", _bucket_of(_key(F.col("_v"), F.col(unique)), points))

    stats = rows.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(value).alias("_s"),
        F.min("_v").alias("_first"),
    )
    # One row per bucket from here on: at most MAX_BUCKETS rows.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = stats.select(
        "_bucket",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_base_sum"),
        F.sum("_n").over(whole).alias("n_rows"),
        F.sum("_s").over(whole).cast("double").alias("grand_total"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_v", unique)
    placed = (
        rows.withColumn("_rn", F.row_number().over(inside))
        .withColumn("_run", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("position", F.col("_rn") + F.col("_base"))
        .withColumn("running", (F.col("_run") + F.col("_base_sum")).cast("double"))
    )
    if not ties:
        return placed.select(*df.columns, "position", "running", "n_rows", "grand_total")
    placed = placed.withColumn("_rk", F.rank().over(Window.partitionBy("_bucket").orderBy("_v")))
    # A tie that began in an earlier bucket: find where its value first appears. Only the value that
    # opens a bucket can be such a tie, so this table too has at most one row per bucket.
    opened = stats.select(F.col("_bucket").alias("_at"), F.col("_first").alias("_value"))
    starts = (
        rows.join(F.broadcast(opened.select("_value").distinct()), rows["_v"] == F.col("_value"))
        .groupBy("_value", "_bucket")
        .agg(F.count(F.lit(1)).alias("_ties"))
        .join(F.broadcast(stats.select("_bucket", "_n")), "_bucket")
        .join(F.broadcast(offsets.select("_bucket", "_base", F.col("_first").alias("_opens"))), "_bucket")
        .select(
            "_value",
            # ties sit at the end of a bucket unless they open it
            F.when(F.col("_opens") == F.col("_value"), F.col("_base") + 1)
            .otherwise(F.col("_base") + F.col("_n") - F.col("_ties") + 1)
            .alias("_start"),
        )
        .groupBy("_value")
        .agg(F.min("_start").alias("_start"))
    )
    ranked = (
        placed.join(F.broadcast(starts), F.col("_v") == F.col("_value"), "left")
        .withColumn(
            "rank",
            F.when(F.col("_v") == F.col("_first"), F.col("_start")).otherwise(F.col("_rk") + F.col("_base")),
        )
    )
    return ranked.select(*df.columns, "position", "running", "n_rows", "grand_total", "rank")



def quantile_of_ordered(value: str, q: float) -> Column:
    """Aggregate: the linearly interpolated quantile of an ascending ``globally_ordered`` table."""
    at = (F.col("n_rows") - 1) * F.lit(float(q)) + 1
    low = F.max(F.when(F.col("position") == F.floor(at), F.col(value)))
    high = F.max(F.when(F.col("position") == F.ceil(at), F.col(value)))
    return low + (high - low) * F.max(at - F.floor(at))
