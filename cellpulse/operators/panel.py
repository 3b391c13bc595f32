"""From raw records to a dense, gap-checked panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.plans.dims import in_dates
from cellpulse.plans.series import CHUNK_STEPS, ordinal, over_series, spread, whole_numbers
from cellpulse.settings import PanelSpec


def null_fill(raw: DataFrame, value: str = "internet", fill: float = 0.0) -> DataFrame:
    """An empty activity field is a present zero; filled before anything is summed."""
    return raw.withColumn(value, F.coalesce(F.col(value), F.lit(float(fill))))


def country_rollup(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Sum the country split away: ``(area, t_index, value, n_rows)``.

    A two-phase aggregate: each task first reduces its own rows, so one area holding a third of the
    records still sends at most one partial row per step and task through the shuffle.
    """
    return (
        raw.select(
            F.col("square_id").cast("long").alias("area"),
            step_of_ms("time_ms", spec).alias("t_index"),
            F.coalesce(F.col("internet"), F.lit(spec.null_fill)).alias("internet"),
        )
        .groupBy("area", "t_index")
        .agg(F.sum("internet").alias("value"), F.count(F.lit(1)).alias("n_rows"))
    )


def step_of_ms(time_ms: str, spec: PanelSpec):
    """Grid index of an epoch-millisecond column."""
    origin = int(spec.t0.replace(tzinfo=dt.timezone.utc).timestamp())
    return F.floor((F.col(time_ms) / 1000 - F.lit(origin)) / spec.step_seconds).cast("long")


def rows_per_cell(rollup: DataFrame) -> DataFrame:
    """Mean and maximum number of country rows per occupied cell."""
    return rollup.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("n_rows").alias("mean_rows"),
        F.max("n_rows").alias("max_rows"),
    )


def country_codes_per_day(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct country codes in each day's file."""
    day = X.local_day(X.to_local(X.from_epoch_seconds(F.floor(F.col("time_ms") / 1000)), spec.tz))
    return raw.groupBy(day.alias("date")).agg(F.countDistinct("country_code").alias("n_codes"))


def _silence() -> dict[str, Column]:
    """What a cell without a record holds."""
    return {"value": F.lit(0.0), "n_rows": F.lit(0).cast("long")}


def seen_steps(rollup: DataFrame) -> DataFrame:
    """Steps for which at least one area has a record."""
    return rollup.select("t_index").distinct()


def densify(rollup: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every area at every *seen* step; silence becomes 0.0 and keeps ``n_rows`` 0.

    Only occupied cells and one mark per area and seen day are shuffled; the silent steps between them are made where they
    lie. Days seen in no area are not made at all, and of the others the steps seen in no area go again.
    """
    seen = seen_steps(rollup)
    days = seen.select(X.idiv("t_index", spec.daily).alias("_day")).distinct()
    ends = days.select("_day", F.lit(1).cast("long").alias("_lo"), F.lit(spec.n_areas).cast("long").alias("_hi"))
    starts = whole_numbers(ends, "_lo", "_hi", "area").select("area", (F.col("_day") * spec.daily).alias("t_index"))
    known = inside_grid(rollup, spec)
    filled = _filled_in_place(known, starts, spec, spec.daily, _silence())
    # no more rows than the period has steps
    return filled.join(F.broadcast(seen) if spec.n_steps <= BROADCAST_STEPS else seen, "t_index", "left_semi").select("area", "t_index", "value", "n_rows")


PLACED_STEPS = 8 * CHUNK_STEPS
"""Up to this length of the period a whole area lies in one partition; longer series are dealt by area and chunk."""
BROADCAST_STEPS = 1_000_000
"""Seen steps are sent to all tasks up to this length of the period; a longer one is joined as Catalyst sees fit."""


def inside_grid(rollup: DataFrame, spec: PanelSpec) -> DataFrame:
    """The roll-up itself; a row outside the areas 1..N or the steps of the period fails the query instead of vanishing."""
    area, step = F.col("area"), F.col("t_index")
    inside = F.coalesce(area.between(1, spec.n_areas) & step.between(0, spec.n_steps - 1), F.lit(False))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("NULL"))
    told = F.raise_error(F.format_string("area %s at step %s lies outside the panel", name(area), name(step)))
    return rollup.withColumn("t_index", F.when(inside, step).otherwise(told))


def full_panel(rollup: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every area at every step of the period, silent cells 0.0: the form all series operators take.

    Only occupied cells are shuffled. A period of at most ``PLACED_STEPS`` leaves the panel partitioned by area, so
    aggregates, joins and windows by area that follow move nothing.
    """
    known = inside_grid(rollup, spec)
    return with_times(_filled_in_place(known, _chunk_starts(rollup, spec), spec, CHUNK_STEPS, _silence()), spec)


def _chunk_starts(like: DataFrame, spec: PanelSpec) -> DataFrame:
    """Area and first step of every chunk of the period."""
    chunks = -(-spec.n_steps // CHUNK_STEPS)
    return like.sparkSession.range(spec.n_areas * chunks).select(
        (X.idiv("id", chunks) + 1).alias("area"), (F.col("id") % chunks * CHUNK_STEPS).alias("t_index")
    )


def _filled_in_place(
    known: DataFrame, starts: DataFrame, spec: PanelSpec, size: int, silent: dict[str, Column], placed: bool = False
) -> DataFrame:
    """``known`` rows and every step that they leave out of the chunks of ``size`` steps whose ``starts`` are given.

    Each row makes the silent steps up to the next row of its area and chunk, so a row never makes more than ``size``
    and the grid itself is not shuffled. ``placed`` says that ``known`` may lie partitioned already; then only the starts
    are moved to it.
    """
    types = dict(known.dtypes)
    cells = spec.n_areas * spec.n_steps
    by_area = spec.n_steps <= PLACED_STEPS
    chunk = X.idiv("t_index", size)
    marks = starts.select("area", "t_index", *[F.lit(None).cast(types[n]).alias(n) for n in silent], F.lit(True).alias("_mark"))
    rows = known.select("area", "t_index", *silent, F.lit(False).alias("_mark"))
    if placed and by_area:
        rows = rows.unionByName(spread(marks, "area", rows=cells)).withColumn("_chunk", chunk)
    else:
        rows = rows.unionByName(marks).withColumn("_chunk", chunk)
        rows = spread(rows, "area", rows=cells) if by_area else spread(rows, "area", "_chunk", rows=cells)
    w = Window.partitionBy("area", "_chunk").orderBy("t_index", F.desc("_mark"))
    end = F.least((F.col("_chunk") + 1) * size, F.lit(spec.n_steps))
    after = rows.withColumn("_next", F.coalesce(F.lead("t_index").over(w), end))
    last = F.col("_next") - 1
    # a known row makes itself at least, also beside one of the same step; a mark that meets one makes nothing
    steps = F.when(~F.col("_mark"), F.sequence("t_index", F.greatest("t_index", last))).when(F.col("_next") > F.col("t_index"), F.sequence("t_index", last))
    made = after.select("area", F.col("t_index").alias("_at"), *silent, "_mark", F.explode(steps).alias("t_index"))
    own = ~F.col("_mark") & (F.col("_at") == F.col("t_index"))
    return made.select("area", "t_index", *[F.when(own, F.col(n)).otherwise(c).alias(n) for n, c in silent.items()])


def with_times(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add ``utc`` and ``local`` wall time of each step."""
    utc = X.step_time("t_index", spec)
    return panel.withColumn("utc", utc).withColumn("local", X.to_local("utc", spec.tz))


def time_index(spec: PanelSpec, spark) -> DataFrame:
    """The step grid of the period as ``(t_index, utc, local)``."""
    return with_times(spark.range(spec.n_steps).select(F.col("id").alias("t_index")), spec)


def stack_days(dense: DataFrame, spec: PanelSpec) -> DataFrame:
    """Place day blocks on the step grid of the period; a step seen in no area stays NULL.

    Day blocks that come from ``densify`` lie where they are needed and are not shuffled again.
    """
    known = inside_grid(dense.select("area", "t_index", "value"), spec)
    silent = {"value": F.lit(None).cast("double")}
    return with_times(_filled_in_place(known, _chunk_starts(dense, spec), spec, CHUNK_STEPS, silent, placed=True), spec)


def gap_runs(missing: DataFrame) -> DataFrame:
    """Consecutive missing steps as ``(start, length)``: a run keeps ``t_index - position`` constant."""
    return (
        ordinal(missing.select("t_index").distinct(), "t_index", "_pos")
        .groupBy((F.col("t_index") - F.col("_pos")).alias("_run"))
        .agg(F.min("t_index").alias("start"), F.count(F.lit(1)).alias("length"))
        .drop("_run")
    )


def missing_steps(panel: DataFrame) -> DataFrame:
    """Steps at which every area is NULL."""
    return (
        panel.groupBy("t_index")
        .agg(F.count("value").alias("_present"))
        .filter("_present = 0")
        .select("t_index")
    )


def interpolate_gaps(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Fill whole-panel gaps of at most ``max_gap`` steps on the line between their neighbours.

    Only steps that are missing in every area are gaps. Longer gaps, gaps at either end of the period and the NULL
    of a single area stay NULL; next to such a NULL there is no line either. ``filled`` marks the new values.
    The look-around is ``max_gap`` steps, so the halo form of the window is exact.
    """
    reach = spec.max_gap + 1
    gaps = missing_steps(panel).withColumn("_gap", F.lit(True))
    marked = panel.join(gaps, "t_index", "left").withColumn("_gap", F.coalesce("_gap", F.lit(False)))

    def build(w):
        seen = F.when(~F.col("_gap"), F.struct("t_index", "value"))
        return {
            "_before": F.last(seen, ignorenulls=True).over(w.rowsBetween(-reach, -1)),
            "_after": F.first(seen, ignorenulls=True).over(w.rowsBetween(1, reach)),
        }

    t0, v0, t1, v1 = F.col("_before.t_index"), F.col("_before.value"), F.col("_after.t_index"), F.col("_after.value")
    weight = (F.col("t_index") - t0) / (t1 - t0)
    line = v0 * (F.lit(1.0) - weight) + v1 * weight
    fillable = F.col("_gap") & ((t1 - t0 - 1) <= spec.max_gap) & line.isNotNull()
    return (
        over_series(marked, build, before=reach, after=reach)
        .withColumn("filled", F.coalesce(fillable, F.lit(False)))
        .withColumn("value", F.when(F.col("filled"), line).otherwise(F.col("value")))
        .select(*[c for c in panel.columns if c != "filled"], "filled")
    )


def cell_totals(panel: DataFrame) -> DataFrame:
    """Total and mean per step of each cell."""
    return panel.groupBy("area").agg(
        F.sum("value").alias("total"),
        (F.sum("value") / F.count(F.lit(1))).alias("mean"),
    )


def date_window(panel: DataFrame, start, days: int) -> DataFrame:
    """Rows of ``days`` local days from ``start``; a stored panel is read for these dates only."""
    end = start + dt.timedelta(days=days - 1)
    inside = X.local_day("local").between(F.lit(start), F.lit(end))
    return panel.filter(inside & F.col("date").between(F.lit(start), F.lit(end)) if "date" in panel.columns else inside)


def holiday_flags(panel: DataFrame, spec: PanelSpec, include_observances: bool = True) -> DataFrame:
    """Flag rows whose local date is a holiday."""
    dates = [d for d, _, scope, _ in spec.holidays if include_observances or scope != "observance"]
    return panel.withColumn("is_holiday", in_dates(X.local_day("local"), dates))
