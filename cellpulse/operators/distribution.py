"""How activity is spread over the cells, and which cells are the busiest.

Everything that needs an order over all cells goes through ``globally_ordered``, which never sorts
the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators.quality import PanelError
from cellpulse.plans.ordering import globally_ordered, quantile_of_ordered
from cellpulse.settings import PanelSpec


def _moments(value: str) -> list[Column]:
    """Order-free statistics: size, sum, spread, population skewness and excess kurtosis."""
    return [
        F.count(value).alias("n_cells"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"),
        F.count_if(F.col(value) == 0).alias("n_zero_cells"),
    ]


def _lognormal(value: str) -> list[Column]:
    logs = F.when(F.col(value) > 0, F.log(F.nullif(value, F.lit(0.0))))
    return [
        F.count(logs).alias("n_positive"),
        F.avg(logs).alias("lognormal_mu"),
        F.stddev_pop(logs).alias("lognormal_sigma"),
    ]


def lognormal_fit(totals: DataFrame, value: str = "total") -> DataFrame:
    """Maximum-likelihood lognormal with location 0, over the positive cells."""
    return totals.filter(F.col(value) > 0).agg(*_lognormal(value))


def lognormal_ks(totals: DataFrame, value: str = "total", unique: str = "area") -> DataFrame:
    """One-sample Kolmogorov-Smirnov test of the fitted lognormal: ln x against its own normal.

    The statistic is the largest gap between the fitted distribution function and the steps just before and at each
    value's position, one aggregate over the ordered table. NULL if no cell is positive or all are equal.
    """
    logs = totals.filter(F.col(value) > 0).select(unique, F.log(value).alias("_x"))
    ordered = globally_ordered(logs, "_x", unique)
    fit = ordered.agg(F.avg("_x").alias("_mu"), F.stddev_pop("_x").alias("_sigma"))  # one row
    level = X.normal_cdf(X.safe_div(F.col("_x") - F.col("_mu"), F.col("_sigma")))
    placed = ordered.join(F.broadcast(fit)).select("position", "n_rows", level.alias("_f"))
    gap = F.greatest(F.col("position") / F.col("n_rows") - F.col("_f"), F.col("_f") - (F.col("position") - 1) / F.col("n_rows"))
    stat = placed.agg(F.max(F.when(F.col("_f").isNotNull(), gap)).alias("lognormal_ks_stat"), F.max("n_rows").alias("_n"))
    pvalue = F.when(F.col("lognormal_ks_stat").isNotNull(), X.kolmogorov_pvalue(F.col("lognormal_ks_stat"), F.col("_n")))
    return stat.select("lognormal_ks_stat", pvalue.alias("lognormal_ks_pvalue"))


def check_non_negative(totals: DataFrame, value: str = "total") -> None:
    if totals.filter(F.col(value) < 0).limit(1).count():
        raise PanelError(f"{value} holds negative values; concentration is undefined")


def _gini(value: str) -> Column:
    weight = 2 * F.col("position") - F.col("n_rows") - 1
    share = X.safe_div(F.sum(weight * F.col(value)), F.max("n_rows") * F.max("grand_total"))
    return _refuse_negative(F.coalesce(share, F.lit(0.0)), value).alias("gini")


def _refuse_negative(result: Column, value: str) -> Column:
    """Concentration of values below zero has no meaning; the query fails instead of answering."""
    told = F.raise_error(F.lit(f"{value} holds negative values; concentration is undefined"))
    return F.when(F.min(value) < 0, told).otherwise(result)


def gini(ordered: DataFrame, value: str = "total") -> DataFrame:
    """Gini coefficient from an ascending ``globally_ordered`` table; 0 when everything is zero."""
    return ordered.agg(_gini(value))


def _top_count(fraction: float) -> Column:
    """Number of cells in the top ``fraction``: rounded half to even, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.bround(F.col("n_rows") * F.lit(fraction), 0).cast("long"))


def _share(inside: Column, value: str) -> Column:
    share = X.safe_div(F.sum(F.when(inside, F.col(value)).otherwise(0.0)), F.max("grand_total"))
    return _refuse_negative(share, value)


def _top_shares(fractions: Sequence[float], value: str) -> list[Column]:
    from_top = F.col("n_rows") - F.col("position") + 1
    return [_share(from_top <= _top_count(f), value).alias(f"top_{round(f * 100)}pct_share") for f in fractions]


TOP_FRACTIONS = (0.01, 0.05, 0.10)


def top_share(ordered: DataFrame, fractions: Sequence[float] = TOP_FRACTIONS, value: str = "total") -> DataFrame:
    """Share of the total held by the largest cells of an ascending ordered table."""
    return ordered.agg(*_top_shares(fractions, value))


def _bottom_half(value: str) -> Column:
    return _share(F.col("position") <= F.floor(F.col("n_rows") / 2), value).alias("bottom_50pct_share")


def bottom_half_share(ordered: DataFrame, value: str = "total") -> DataFrame:
    """Share held by the lowest ``n // 2`` cells."""
    return ordered.agg(_bottom_half(value))


def distribution_stats(totals: DataFrame, value: str = "total", unique: str = "area") -> DataFrame:
    """The whole distribution record in one row, from one aggregate over the ordered table."""
    ordered = globally_ordered(totals.select(unique, value), value, unique)
    out = ordered.agg(
        *_moments(value),
        *_lognormal(value),
        quantile_of_ordered(value, 0.5).alias("median"),
        _gini(value),
        *_top_shares(TOP_FRACTIONS, value),
        _bottom_half(value),
    )
    return out.withColumn("max_over_median", X.safe_div(F.col("maximum"), F.col("median")))


def log_histogram(totals: DataFrame, bins: int = 60, value: str = "total") -> DataFrame:
    """Counts in ``bins`` log-spaced bins between the smallest and largest positive value."""
    logs = totals.filter(F.col(value) > 0).select(F.log10(value).alias("x"))
    ends = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    slot = F.when(F.col("hi") == F.col("lo"), 1).otherwise(
        F.least(F.lit(bins), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1)
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        logs.join(F.broadcast(ends))
        .groupBy(slot.cast("int").alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first(F.pow(F.lit(10.0), F.col("lo") + (slot - 1) * width)).alias("lower"),
            F.first(F.pow(F.lit(10.0), F.col("lo") + slot * width)).alias("upper"),
        )
    )


def ccdf(totals: DataFrame, value: str = "total", unique: str = "area") -> DataFrame:
    """Cells from largest to smallest with the share of cells at least that large."""
    ordered = globally_ordered(totals.select(unique, value), value, unique, descending=True)
    return ordered.select(unique, value, "position", (F.col("position") / F.col("n_rows")).alias("ccdf"))


def ranked_cells(totals: DataFrame, value: str = "total", unique: str = "area") -> DataFrame:
    """Position of every cell by descending total; equal totals are ordered by id."""
    ordered = globally_ordered(totals.select(unique, value), value, unique, descending=True, ties=True)
    return ordered.select(unique, value, "position", "rank")


def top_areas(totals: DataFrame, k: int = 3, value: str = "total", unique: str = "area") -> DataFrame:
    """The ``k`` busiest cells; a bounded heap per task, no global sort."""
    best = totals.orderBy(F.desc(value), F.asc(unique)).limit(k)
    # at most k rows from here on
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc(value), F.asc(unique))))


def select_areas(totals: DataFrame, spec: PanelSpec, k: int = 3) -> DataFrame:
    """One nested record: busiest cell, top ids, fixed ids, and rank and total of all of them."""
    best = [row["area"] for row in top_areas(totals, k).collect()]  # k ids
    wanted = list(dict.fromkeys([*best, *spec.fixed_areas]))
    named = ranked_cells(totals).filter(F.col("area").isin(wanted))
    entries = F.sort_array(F.collect_list(F.struct("area", "position", "total")))  # at most k + fixed rows
    return named.agg(entries.alias("e")).select(
        F.lit(best[0]).alias("top_traffic"),
        F.array(*[F.lit(a) for a in best]).alias("top_three"),
        F.array(*[F.lit(a) for a in spec.fixed_areas]).cast("array<bigint>").alias("fixed"),
        F.array(*[F.lit(a) for a in best]).alias("forecast"),
        F.map_from_entries(F.transform("e", lambda e: F.struct(e["area"].cast("string"), e["position"]))).alias("ranks"),
        F.map_from_entries(F.transform("e", lambda e: F.struct(e["area"].cast("string"), e["total"]))).alias("totals"),
    )


def plotted_areas(totals: DataFrame, spec: PanelSpec, k: int = 3) -> DataFrame:
    """Top ids then fixed ids, each once, in that order."""
    best = top_areas(totals, k).select("area", F.col("position").cast("long").alias("pos"))
    rows = totals.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(int(a)) for a in spec.fixed_areas]).cast("array<bigint>")).alias("i", "area")
    )
    fixed = rows.select("area", (F.col("i") + F.lit(k + 1)).cast("long").alias("pos"))
    return best.unionByName(fixed).groupBy("area").agg(F.min("pos").alias("pos"))


def extract_series(panel: DataFrame, areas: Sequence[int], spec: PanelSpec) -> DataFrame:
    """Named cells as one column each, in the order asked for; an unknown id is an error."""
    unknown = [a for a in areas if not 1 <= a <= spec.n_areas]
    if unknown:
        raise PanelError(f"no such area: {unknown}; ids run from 1 to {spec.n_areas}")
    # the filter reaches the scan; what is left is one row per step and requested area
    return (
        panel.filter(F.col("area").isin(list(areas)))
        .groupBy("t_index", "utc", "local")
        .agg(*[F.max(F.when(F.col("area") == a, F.col("value"))).alias(f"square_{a}") for a in areas])
    )


def normalise_by_peak(panel: DataFrame) -> DataFrame:
    """Value over the area's maximum; an all-zero area stays as it is."""
    peaks = panel.groupBy("area").agg(F.max("value").alias("_peak"))
    scaled = F.when(F.col("_peak") > 0, F.col("value") / F.nullif("_peak", F.lit(0.0))).otherwise(F.col("value"))
    return panel.join(peaks, "area").withColumn("normalised", scaled).drop("_peak")


def area_summary(panel: DataFrame) -> DataFrame:
    """Descriptive statistics per area, in one aggregate.

    The exact percentiles keep counts of distinct values, so their state is bounded by the number of
    steps of one area.
    """
    hour = F.hour("local")
    night = F.when((hour >= 2) & (hour < 5), F.col("value"))
    weekend = X.is_weekend("local")
    stats = panel.groupBy("area").agg(
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.percentile("value", F.lit(0.01)).alias("_trough"),
        F.median(night).alias("night_floor"),
        F.avg(F.when(~weekend, F.col("value"))).alias("weekday_mean"),
        F.avg(F.when(weekend, F.col("value"))).alias("weekend_mean"),
        F.count_if(F.col("value") == 0).alias("n_zero"),
    )
    return stats.select(
        "area",
        "mean",
        "median",
        "std",
        X.safe_div(F.col("std"), F.col("mean")).alias("cv"),
        "min",
        "max",
        F.when(F.col("_trough") != 0, F.col("max") / F.nullif("_trough", F.lit(0.0)))
        .otherwise(F.lit(float("inf")))
        .alias("peak_to_trough"),
        "night_floor",
        X.safe_div(F.col("night_floor"), F.col("mean")).alias("night_floor_over_mean"),
        "weekday_mean",
        "weekend_mean",
        X.safe_div(F.col("weekend_mean"), F.col("weekday_mean")).alias("weekend_over_weekday"),
        "n_zero",
    )


def daily_mean_std_corr(panel: DataFrame) -> DataFrame:
    """Correlation of the daily mean with the daily standard deviation, raw and under log1p."""
    logged = F.log1p("value")
    days = panel.groupBy("area", X.local_day("local").alias("date")).agg(
        F.avg("value").alias("m"),
        F.stddev_pop("value").alias("s"),
        F.avg(logged).alias("ml"),
        F.stddev_pop(logged).alias("sl"),
    )
    return days.groupBy("area").agg(F.corr("m", "s").alias("corr_raw"), F.corr("ml", "sl").alias("corr_log1p"))


def busiest_day(panel: DataFrame) -> DataFrame:
    """The day with the largest total per area; the earliest one among equals."""
    days = panel.groupBy("area", X.local_day("local").alias("date")).agg(F.sum("value").alias("total"))
    first = -F.datediff("date", F.lit("1970-01-01"))
    best = F.max_by(F.struct("date", "total"), F.struct(F.round("total", 6), first))
    return days.groupBy("area").agg(best.alias("b")).select("area", "b.date", "b.total")
