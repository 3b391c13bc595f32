"""Key figures over run tables: ``facts(group, key, value, unit)`` and the experiment log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.settings import PanelSpec

BASELINES = ("persistence", "seasonal_naive")


def as_facts(wide: DataFrame, group: str, units: dict[str, str] | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """One row per figure of a one-row table."""
    names = list(keys or wide.columns)
    units = units or {}
    entries = [
        F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value"), F.lit(units.get(n, "")).alias("unit"))
        for n in names
    ]
    return wide.select(F.lit(group).alias("group"), F.inline(F.array(*entries)))


def fact_dataset(raw: DataFrame, rollup: DataFrame, spec: PanelSpec) -> DataFrame:
    """Size and occupancy of the data. One pass over the cells; only the code count reads the records."""
    cells = rollup.agg(
        F.sum("n_rows").alias("total_raw_rows"),
        F.count(F.lit(1)).alias("occupied_cells"),
        F.max("n_rows").alias("max_rows_per_cell"),
        F.countDistinct("t_index").alias("seen_steps"),
        F.sum("value").alias("total_activity"),
    )
    codes = raw.agg(F.countDistinct("country_code").alias("country_codes"))
    grid = F.col("seen_steps") * F.lit(spec.n_areas)
    wide = cells.join(F.broadcast(codes)).select(
        F.lit(spec.n_days).alias("n_days"),
        F.lit(spec.n_areas).alias("n_squares"),
        F.lit(spec.n_steps).alias("n_timestamps"),
        "total_raw_rows",
        (F.col("total_raw_rows") / F.lit(spec.n_days)).alias("mean_rows_per_day"),
        (grid - F.col("occupied_cells")).alias("absent_cells"),
        (100 * (grid - F.col("occupied_cells")) / grid).alias("absent_cells_pct"),
        (F.col("total_raw_rows") / F.col("occupied_cells")).alias("mean_rows_per_cell"),
        "max_rows_per_cell",
        (F.lit(spec.n_steps) - F.col("seen_steps")).alias("missing_intervals"),
        "country_codes",
        "total_activity",
    )
    return as_facts(wide, "Dataset", {"absent_cells_pct": "%", "n_days": "days"})


def fact_throughput(log: DataFrame, total_bytes: Column) -> DataFrame:
    """Binary MiB/s and decimal Mbit/s of a download log."""
    wide = log.agg(F.sum("download_s").alias("s"), F.sum(total_bytes).alias("b")).select(
        X.safe_div(F.col("b") / F.lit(1024.0**2), F.col("s")).alias("download_mib_per_s"),
        X.safe_div(F.col("b") * 8 / F.lit(1e6), F.col("s")).alias("download_mbit_per_s"),
    )
    return as_facts(wide, "Timing", {"download_mib_per_s": "MiB/s", "download_mbit_per_s": "Mbit/s"})


def mean_mase(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.avg("mase").alias("mase_mean"))


def fact_models(scores: DataFrame, reference: str = "persistence") -> DataFrame:
    """Best model by mean MASE, its gain over the reference, and how many models beat the reference."""
    means = mean_mase(scores)
    base = F.max(F.when(F.col("model") == reference, F.col("mase_mean")))
    best = F.min_by(F.struct("model", "mase_mean"), F.struct(F.round("mase_mean", 9), "model"))
    one = means.filter("mase_mean is not null").agg(best.alias("b"), base.alias("base"), F.collect_list(F.struct("model", "mase_mean")).alias("all"))
    below = lambda m: F.round(m["mase_mean"], 9) < F.round("base", 9)
    beating = F.size(F.filter("all", lambda m: (m["model"] != reference) & below(m)))
    return one.select(
        F.col("b.model").alias("best_model"),
        F.col("b.mase_mean").alias("best_mase"),
        (100 * X.safe_div(F.col("base") - F.col("b.mase_mean"), F.col("base"))).alias("gain_over_persistence_pct"),
        beating.alias("models_beating_persistence"),
    )


def fact_best_model(scores: DataFrame) -> DataFrame:
    return fact_models(scores).select("best_model", "best_mase")


def fact_gain_over_persistence(scores: DataFrame) -> DataFrame:
    return fact_models(scores).select("gain_over_persistence_pct")


def fact_models_beating(scores: DataFrame) -> DataFrame:
    return fact_models(scores).select("models_beating_persistence")


def _against(scores: DataFrame, reference: str) -> DataFrame:
    base = scores.filter(F.col("model") == reference).select("area", F.col("mase").alias("base"))
    return scores.filter(~F.col("model").isin(list(BASELINES))).join(base, "area")


def fact_stress_ratio(scores: DataFrame, reference: str = "persistence") -> DataFrame:
    """Worst per-area MASE of each fitted model relative to the reference on the same area."""
    ratio = X.safe_div(F.col("mase"), F.col("base"))
    return _against(scores, reference).groupBy("model").agg(F.max(ratio).alias("worst_ratio"))


def fact_persistence_wins(scores: DataFrame, reference: str = "persistence") -> DataFrame:
    """Areas on which no fitted model is below the reference; equal to nine digits is not below."""
    base = scores.filter((F.col("model") == reference) & F.col("mase").isNotNull()).select("area")
    beaten = _against(scores, reference).filter(F.round("mase", 9) < F.round("base", 9)).select("area").distinct()
    return base.join(beaten, "area", "left_anti").agg(F.count(F.lit(1)).alias("areas_persistence_wins"))


def fact_copy_min(copying: DataFrame) -> DataFrame:
    return _fitted(copying).agg(F.min("copy_ratio").alias("copy_ratio_min"))


def fact_collapsed(copying: DataFrame) -> DataFrame:
    return _fitted(copying).agg(F.count_if(F.col("verdict") == "collapsed").alias("models_collapsed"))


def _fitted(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("model").isin(list(BASELINES)))


def fact_cost_ratio(timing: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Milliseconds per step of two models and their ratio, per area."""
    ms = lambda m: F.max(F.when(F.col("model") == m, F.col("inference_ms_per_step")))
    return timing.groupBy("area").agg(ms(numerator).alias("ms_numerator"), ms(denominator).alias("ms_denominator")).withColumn(
        "cost_ratio", X.safe_div(F.col("ms_numerator"), F.col("ms_denominator"))
    )


# --- experiment log --------------------------------------------------------------------------------


def log_filter(log: DataFrame, model: str | None = None, area: int | None = None, stage: str | None = None) -> DataFrame:
    out = log
    for name, wanted in (("model", model), ("area", area), ("stage", stage)):
        if wanted is not None:
            out = out.filter(F.col(name) == wanted)
    return out


def log_best(log: DataFrame, metric: str = "valid_mae") -> DataFrame:
    """The row with the smallest metric for each model and area; NULL and NaN never win."""
    usable = log.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    row = F.min_by(F.struct(*[c for c in log.columns if c not in ("model", "area")]), F.struct(F.round(metric, 9), "stage", "seed"))
    return usable.groupBy("model", "area").agg(row.alias("r")).select("model", "area", "r.*")


def log_summary(log: DataFrame) -> DataFrame:
    """Counts by model, by stage, and in total, from one expanded aggregate."""
    return log.groupingSets([[F.col("model")], [F.col("stage")], []], "model", "stage").agg(F.count(F.lit(1)).alias("n"))


def sweep_spread(log: DataFrame, metric: str = "valid_mae", order: str = "stage_order") -> DataFrame:
    """Spread of each tuning stage and its gain over the best of the stage before, per model."""
    stages = log.groupBy("model", "stage").agg(
        F.min(order).alias("stage_order"), F.min(metric).alias("best"), F.max(metric).alias("worst"), F.count(metric).alias("n")
    )
    w = Window.partitionBy("model").orderBy("stage_order")  # one row per stage
    before = F.lag("best").over(w)
    return stages.select(
        "model",
        "stage",
        "n",
        "best",
        "worst",
        X.safe_div(F.col("worst") - F.col("best"), F.col("best")).alias("spread"),
        (before - F.col("best")).alias("gain"),
        X.safe_div(before - F.col("best"), before).alias("gain_share"),
    )


def ablation_delta(log: DataFrame, flag: str, metric: str = "valid_mae") -> DataFrame:
    """How much a score worsens per model when a switch is off."""
    means = log.groupBy("model").agg(
        F.avg(F.when(F.col(flag), F.col(metric))).alias("with_it"), F.avg(F.when(~F.col(flag), F.col(metric))).alias("without_it")
    )
    delta = F.col("without_it") - F.col("with_it")
    return means.select("model", "with_it", "without_it", delta.alias("delta"), X.safe_div(delta, F.col("with_it")).alias("delta_share"))
