"""Checks on records, days and the assembled panel. A check returns its violations; none means pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.plans.series import whole_numbers
from cellpulse.settings import PanelSpec


class PanelError(RuntimeError):
    """The data contradicts the declared panel."""


def demand_empty(violations: DataFrame, what: str, show: int = 5) -> None:
    """Fail with a few example rows if a check found anything."""
    rows = violations.limit(show).collect()
    if rows:
        raise PanelError(f"{what}: {[r.asDict() for r in rows]}")


def check_square_range(raw: DataFrame, spec: PanelSpec, column: str = "square_id") -> DataFrame:
    """Ids outside 1..N with their row counts."""
    return (
        raw.filter(~F.col(column).between(1, spec.n_areas))
        .groupBy(F.col(column).cast("long").alias("area"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def day_stats(raw: DataFrame, rollup: DataFrame, spec: PanelSpec) -> DataFrame:
    """Provenance per local day, from the rolled-up cells (the raw rows are counted in them)."""
    day = X.local_day(X.to_local(X.step_time("t_index", spec), spec.tz))
    by_day = rollup.groupBy(day.alias("date")).agg(
        F.sum("n_rows").alias("n_raw_rows"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.countDistinct("t_index").alias("n_timestamps"),
        F.sum("value").alias("total"),
    )
    cells = F.col("n_timestamps") * F.lit(spec.n_areas)
    return by_day.select(
        "date",
        "n_raw_rows",
        "n_pairs",
        (cells - F.col("n_pairs")).alias("n_absent"),
        "n_timestamps",
        F.lit(spec.n_areas).cast("long").alias("n_squares"),
        "total",
        ((cells - F.col("n_pairs")) / cells).alias("absent_fraction"),
    )


def check_day_length(rollup: DataFrame, spec: PanelSpec) -> DataFrame:
    """Days whose number of seen steps is not the daily period."""
    day = X.local_day(X.to_local(X.step_time("t_index", spec), spec.tz))
    return (
        rollup.groupBy(day.alias("date"))
        .agg(F.countDistinct("t_index").alias("n_timestamps"))
        .filter(F.col("n_timestamps") != spec.daily)
    )


def expected_days(spark: SparkSession, spec: PanelSpec) -> DataFrame:
    """Every date of the period."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(spec.start), F.lit(spec.end))).alias("date"))


def missing_days(present: DataFrame, spec: PanelSpec) -> DataFrame:
    """Dates of the period for which nothing was ingested."""
    return expected_days(present.sparkSession, spec).join(present.select("date").distinct(), "date", "left_anti")


def grid_gaps(times: DataFrame) -> DataFrame:
    """Steps between the first and last seen one that were not seen.

    The full sequence is generated in blocks over all tasks; no row or task holds all of it.
    """
    seen = times.select("t_index").distinct()
    ends = seen.agg(F.min("t_index").alias("lo"), F.max("t_index").alias("hi")).filter("lo is not null")
    full = whole_numbers(ends, "lo", "hi", "t_index").select("t_index")
    return full.join(seen, "t_index", "left_anti")


def duplicate_times(times: DataFrame, column: str = "t_index") -> DataFrame:
    """Index entries that occur more than once."""
    return times.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dst_check(times: DataFrame, spec: PanelSpec) -> DataFrame:
    """Local days not holding exactly the daily number of steps (23- and 25-hour days)."""
    return (
        times.groupBy(X.local_day("local").alias("date"))
        .agg(F.count(F.lit(1)).alias("n_steps"))
        .filter(F.col("n_steps") != spec.daily)
    )


def gap_escalation(unfilled: DataFrame, spec: PanelSpec, split: str = "test") -> DataFrame:
    """Unfilled steps inside a split; any row means the split cannot be scored."""
    part = spec.split(split)
    local = X.to_local(X.step_time("t_index", spec), spec.tz)
    return unfilled.select("t_index", local.alias("local")).filter(
        X.local_day("local").between(F.lit(part.start), F.lit(part.end))
    )


def null_audit(panel: DataFrame) -> DataFrame:
    """Cells still NULL after the gap policy."""
    return panel.agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.count(F.lit(1)).alias("n_cells"))


def panel_report(panel: DataFrame, rollup: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row describing the assembled panel."""
    by_step = panel.groupBy("t_index", "utc", "local").agg(
        F.count("value").alias("_present"),
        F.sum("value").alias("_total"),
        F.count(F.lit(1)).alias("_cells"),
    )
    shape = by_step.agg(
        F.count(F.lit(1)).alias("n_timestamps"),
        F.max("_cells").alias("n_areas"),
        F.min("utc").alias("first_utc"),
        F.max("utc").alias("last_utc"),
        F.min("local").alias("first_local"),
        F.max("local").alias("last_local"),
        F.sum("_total").alias("total"),
        F.sum(F.col("_cells") - F.col("_present")).alias("n_null"),
        F.count_if(F.col("_present") == 0).alias("n_missing_steps"),
        # data loss is the exception, and the list is one entry per lost step, not per cell
        F.array_sort(F.collect_list(F.when(F.col("_present") == 0, F.col("utc")))).alias("missing_utc"),
    )
    occupied = rollup.agg(F.count(F.lit(1)).alias("_occupied"), F.countDistinct("t_index").alias("_seen"))
    return shape.join(F.broadcast(occupied)).select(
        *shape.columns, (F.col("_seen") * F.lit(spec.n_areas) - F.col("_occupied")).alias("n_absent")
    )


def report_entries(stacked: DataFrame, filled: DataFrame, spec: PanelSpec) -> DataFrame:
    """What the report of a panel lists, one row per entry, as ``(kind, at)``.

    ``missing``: steps seen in no area; ``interpolated`` and ``unfilled``: those of them that the gap policy filled in some area,
    or in none; ``wrong_day``: local days with another number of seen steps than a day has. ``stacked`` is the panel
    before the gap policy and ``filled`` after it.
    """
    before = stacked.groupBy("t_index", "utc", "local").agg(F.count("value").alias("_present"))
    after = filled.groupBy("t_index").agg(F.count_if("filled").alias("_filled"))
    missing = before.filter("_present = 0").join(after, "t_index")
    kinds = F.array(F.lit("missing"), F.when(F.col("_filled") > 0, "interpolated").otherwise("unfilled"))
    days = before.groupBy(X.local_day("local").alias("date")).agg(F.count_if(F.col("_present") > 0).alias("_steps"))
    wrong = days.filter(F.col("_steps") != spec.daily).select(F.lit("wrong_day").alias("kind"), F.col("date").cast("timestamp_ntz").alias("at"))
    return missing.select(F.explode(kinds).alias("kind"), F.col("utc").alias("at")).unionByName(wrong)


def absent_by_split(days: DataFrame, spec: PanelSpec) -> DataFrame:
    """Mean and total absent cells per day in each split."""
    return (
        days.withColumn("split", X.split_label("date", spec.splits))
        .filter("split is not null")
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.avg("n_absent").alias("mean_absent"),
            F.max("n_absent").alias("max_absent"),
        )
    )


def reconcile_totals(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Two computations of the same daily totals, side by side with their relative difference."""
    a, b = F.coalesce("total_a", F.lit(0.0)), F.coalesce("total_b", F.lit(0.0))
    joined = left.select("date", F.col("total").alias("total_a")).join(
        right.select("date", F.col("total").alias("total_b")), "date", "full_outer"
    )
    gap = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    both = F.col("total_a").isNotNull() & F.col("total_b").isNotNull()
    return joined.withColumn("rel_diff", gap).withColumn("agrees", both & (gap <= tolerance))


def ingest_summary(log: DataFrame) -> DataFrame:
    """One row over a run log: days, rows, times, memory, and the day with most absent cells."""
    worst = F.max_by("date", F.struct("absent_cells", -F.datediff("date", F.lit("1970-01-01"))))
    return log.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.sum("raw_rows").alias("total_raw_rows"),
        (F.sum("download_s") / 60).alias("download_total_min"),
        F.avg("download_s").alias("download_mean_s"),
        F.coalesce(F.stddev_samp("download_s"), F.lit(0.0)).alias("download_std_s"),
        (F.sum("ingest_s") / 60).alias("ingest_total_min"),
        F.avg("ingest_s").alias("ingest_mean_s"),
        F.coalesce(F.stddev_samp("ingest_s"), F.lit(0.0)).alias("ingest_std_s"),
        F.max("peak_rss_mib").alias("peak_rss_max_mib"),
        F.avg("peak_rss_mib").alias("peak_rss_mean_mib"),
        F.sum("absent_cells").alias("absent_total"),
        F.avg("absent_cells").alias("absent_mean_per_day"),
        F.max("absent_cells").alias("absent_max_per_day"),
        worst.alias("absent_max_day"),
    )


def benchmark_summary(runs: DataFrame, baseline: str) -> DataFrame:
    """Mean peak and wall per strategy with the baseline's peak as a multiple of it."""
    means = runs.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("peak").alias("mean_peak"), F.avg("wall_s").alias("mean_wall_s")
    )
    # a global aggregate: exactly one row
    base = runs.filter(F.col("strategy") == baseline).agg(F.avg("peak").alias("_base"))
    return means.join(F.broadcast(base)).select(
        *means.columns, X.safe_div(F.col("_base"), F.col("mean_peak")).alias("baseline_over_peak")
    )
