"""Forecast scores per (area, split, model, seed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.plans.series import over_series
from cellpulse.settings import PanelSpec

SCORE_KEYS = ("area", "split", "model", "seed")


def mase_scale(labelled: DataFrame, spec: PanelSpec) -> DataFrame:
    """Mean absolute seasonal difference over the train split, one row per area.

    The difference must lie inside train: the first season of train has no partner and is left out.
    """
    train = labelled.filter(F.col("split") == "train").select("area", "t_index", "value")
    diffs = over_series(
        train, lambda w: {"_d": F.abs(F.col("value") - F.lag("value", spec.daily).over(w))}, before=spec.daily
    )
    return diffs.groupBy("area").agg(F.avg("_d").alias("mase_scale"))


def mase_violations(scale: DataFrame) -> DataFrame:
    """Areas whose training series is too short or exactly periodic, so that MASE is undefined."""
    return scale.filter(F.col("mase_scale").isNull() | (F.col("mase_scale") == 0))


def error_columns(spec: PanelSpec) -> dict[str, Column]:
    """Every scale-dependent and percentage score as an aggregate; NULL where it is undefined."""
    y, p = F.col("observed"), F.col("predicted")
    e = p - y
    size, level = F.abs(e), F.abs(y)
    ratio = size / F.nullif(level, F.lit(0.0))
    both = level + F.abs(p)
    return {
        "n": F.count(e),
        "mae": F.avg(size),
        "rmse": F.sqrt(F.avg(e * e)),
        "bias": F.avg(e),
        "mape": 100 * F.avg(ratio),
        "mape_excl_small": 100 * F.avg(F.when(level >= spec.mape_floor, ratio)),
        "n_small": F.count_if(level < spec.mape_floor),
        "smape": 100 * F.avg(F.coalesce(2 * size / F.nullif(both, F.lit(0.0)), F.lit(0.0))),
        "wape": 100 * X.safe_div(F.sum(size), F.sum(level)),
        "r2": 1 - X.safe_div(F.sum(e * e), F.when(F.var_pop(y) > 0, F.var_pop(y) * F.count(y))),
    }


def metric_table(predictions: DataFrame, scale: DataFrame, spec: PanelSpec, keys: Sequence[str] = SCORE_KEYS) -> DataFrame:
    """All scores in one aggregate, then the train-only MASE scale joined on the area."""
    scores = predictions.groupBy(*keys).agg(*[c.alias(n) for n, c in error_columns(spec).items()])
    return scores.join(scale, "area", "left").withColumn("mase", X.safe_div(F.col("mae"), F.col("mase_scale"))).drop("mase_scale")


def ranked(scores: DataFrame) -> DataFrame:
    """Scores with the best model of each area and split first."""
    return scores.orderBy("area", "split", F.asc_nulls_last("mase"), "model", "seed")


def inference_ms(rows: DataFrame) -> DataFrame:
    """Milliseconds per forecast step."""
    return rows.withColumn("inference_ms_per_step", 1000 * X.safe_div(F.col("inference_wall_s"), F.col("n").cast("double")))


def seed_spread(scores: DataFrame, names: Sequence[str] = ("mae", "rmse", "mape", "smape", "mase", "r2", "bias")) -> DataFrame:
    """Mean and sample standard deviation over seeds; 0 for a single seed."""
    aggs = [F.count(F.lit(1)).alias("n_seeds")]
    for name in names:
        aggs.append(F.avg(name).alias(name))
        spread = F.coalesce(F.stddev_samp(name), F.lit(0.0))
        aggs.append(F.when(F.count(name) > 0, spread).alias(f"{name}_std"))
    return scores.groupBy("area", "split", "model").agg(*aggs)
