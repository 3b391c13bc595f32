"""Points where a seasonal-naive predictor fails unusually badly, and how they relate to holidays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators.quality import PanelError
from cellpulse.operators.series import difference
from cellpulse.plans.dims import literal_table
from cellpulse.settings import PanelSpec

MAD_TO_SIGMA = 1.4826  # fixed value: makes the MAD of a normal sample estimate its sigma


def with_scale(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median (``centre``) and robust ``scale`` of its group beside each row, by windows: nothing is joined.

    The scale is 1.4826 MAD, or the population standard deviation where the MAD is zero. A window holds one group, which
    here is one phase of one series, and a panel that lies by area is not moved. A join would be planned by the size of the
    tables read, which says nothing about a filled panel: the panel itself could be sent through the driver.
    """
    group = Window.partitionBy(*keys)
    centred = rows.withColumn("centre", F.median(value).over(group)).withColumn("_sd", F.stddev_pop(value).over(group))
    spread = centred.withColumn("_mad", F.median(F.abs(F.col(value) - F.col("centre"))).over(group))
    scale = F.when(F.col("_mad") > 0, F.lit(MAD_TO_SIGMA) * F.col("_mad")).otherwise(F.col("_sd"))
    return spread.withColumn("scale", scale).drop("_sd", "_mad")


def robust_scale(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and 1.4826 MAD per group; population standard deviation where the MAD is zero."""
    return with_scale(rows, keys, value).groupBy(*keys).agg(F.any_value("centre").alias("centre"), F.any_value("scale").alias("scale"))


def seasonal_residuals(panel: DataFrame, spec: PanelSpec, seasonal: int, value: str = "value") -> DataFrame:
    """``v(t) - v(t - seasonal)`` for every step that has a full season behind it."""
    if spec.n_steps <= seasonal:
        raise PanelError(f"{spec.n_steps} steps are shorter than period {seasonal}")
    return difference(panel, seasonal, value, name="residual").filter(F.col("t_index") >= seasonal)


def scored(
    panel: DataFrame, spec: PanelSpec, seasonal: int, *, per_phase: bool = True, value: str = "value"
) -> DataFrame:
    """Every evaluable step with residual, scale and robust z; a zero scale gives z 0."""
    rows = seasonal_residuals(panel, spec, seasonal, value).withColumn(
        "phase", F.pmod(F.col("t_index"), F.lit(seasonal)) if per_phase else F.lit(0)
    )
    scales = with_scale(rows, ("area", "phase"), "residual")
    z = F.coalesce(X.safe_div(F.abs(F.col("residual") - F.col("centre")), F.col("scale")), F.lit(0.0))
    return scales.withColumn("z", z).drop("centre")


def seasonal_anomalies(panel: DataFrame, spec: PanelSpec, seasonal: int, threshold: float = 4.0, **how) -> DataFrame:
    """Steps with z above ``threshold``."""
    return scored(panel, spec, seasonal, **how).filter(F.col("z") > threshold)


def anomaly_rate(scores: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Flags and their share of the evaluable steps per area, with the median scale."""
    return scores.groupBy("area").agg(
        F.count_if(F.col("z") > threshold).alias("n_flagged"),
        F.count(F.lit(1)).alias("n_evaluable"),
        F.avg((F.col("z") > threshold).cast("double")).alias("fraction_flagged"),
        F.median("scale").alias("scale"),
    )


def holiday_dim(spark, spec: PanelSpec, include_observances: bool = True) -> DataFrame:
    rows = [h for h in spec.holidays if include_observances or h[2] != "observance"]
    return literal_table(spark, rows, ("date", "name", "scope", "note"), ("date", "string", "string", "string"))


def anomaly_enrich(flags: DataFrame, spec: PanelSpec) -> DataFrame:
    """Flagged rows with weekday name and the holiday of their local date."""
    days = holiday_dim(flags.sparkSession, spec).select("date", F.col("name").alias("holiday"))
    return (
        flags.withColumn("date", X.local_day("local"))
        .join(F.broadcast(days), "date", "left")
        .withColumn("weekday", F.date_format("local", "EEEE"))
        .withColumn("is_holiday", F.col("holiday").isNotNull())
    )


def anomalies_per_date(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("area").alias("n_areas"), F.max("z").alias("max_z")
    )


def binomial_upper_tail(counts: DataFrame, k: str, n: str, p: float, name: str) -> DataFrame:
    """P(X >= k) for X ~ Binomial(n, p) as a column, from I_p(k, n - k + 1): no table of terms, no join.

    The work of a row grows with the root of n. No success asked for gives 1, more than n gives 0, a NULL gives NULL.
    """
    hits, trials = F.col(k).cast("double"), F.col(n).cast("double")
    # the arguments of rows that are settled anyway are kept in the domain
    inner = F.least(F.greatest(hits, F.lit(1.0)), F.greatest(trials, F.lit(1.0)))
    size = F.greatest(trials, F.lit(1.0))
    tail = X.incomplete_beta(inner, size - inner + 1, F.lit(float(p)), 60 + F.ceil(8 * F.sqrt(size)))
    settled = F.when(hits.isNull() | trials.isNull(), F.lit(None).cast("double")).when(hits <= 0, 1.0).when(hits > trials, 0.0)
    return counts.withColumn(name, settled.otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))))


def holiday_enrichment(enriched: DataFrame, spec: PanelSpec) -> DataFrame:
    """Share of flags on holidays against the holidays' share of days, with the one-sided binomial p."""
    days = [h for h in spec.holidays if spec.start <= h[0] <= spec.end]
    share = len(days) / spec.n_days
    counts = enriched.agg(F.count_if("is_holiday").alias("on_holiday"), F.count(F.lit(1)).alias("n_flagged"))
    tail = binomial_upper_tail(counts, "on_holiday", "n_flagged", share, "p_value")
    return tail.select(
        "on_holiday",
        "n_flagged",
        X.safe_div(F.col("on_holiday").cast("double"), F.col("n_flagged").cast("double")).alias("share_on_holidays"),
        F.lit(share).alias("share_of_days"),
        (X.safe_div(F.col("on_holiday").cast("double"), F.col("n_flagged").cast("double")) / F.lit(share)).alias("enrichment"),
        "p_value",
    )
