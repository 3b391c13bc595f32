"""When and how forecasts fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators.series import lag_products
from cellpulse.plans.series import over_series
from cellpulse.plans.storage import durable
from cellpulse.settings import PanelSpec

KEYS = ("area", "split", "model")
COLLAPSED, NEAR = 0.25, 0.6  # fixed values: verdict limits of the copy ratio


def _miss() -> Column:
    return F.abs(F.col("observed") - F.col("predicted"))


def _filled_cells(predictions: DataFrame, cell: Column, n_cells: int, keys: Sequence[str]) -> DataFrame:
    """MAE and count per key and cell 0..n_cells-1; cells without data are NULL with count 0.

    The per-key map has at most ``n_cells`` entries, so the empty cells need no join.
    """
    found = predictions.groupBy(*keys, cell.alias("cell")).agg(F.avg(_miss()).alias("mae"), F.count(F.lit(1)).alias("n"))
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("mae", "n")))).alias("m"))
    rows = maps.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))).alias("cell"))
    got = F.try_element_at("m", F.col("cell"))
    return rows.select(*keys, "cell", got["mae"].alias("mae"), F.coalesce(got["n"], F.lit(0).cast("long")).alias("n"))


def error_by_hour(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _filled_cells(predictions, F.hour("local"), 24, keys).withColumnRenamed("cell", "hour")


def error_heatmap(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Day-of-week (Monday first) by hour-of-day MAE."""
    cell = F.weekday("local") * 24 + F.hour("local")
    return _filled_cells(predictions, cell, 168, keys).select(
        *keys, F.floor(F.col("cell") / 24).cast("int").alias("weekday"), (F.col("cell") % 24).alias("hour"), "mae", "n"
    )


def error_by_daytype(predictions: DataFrame, spec: PanelSpec, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weekday against weekend and ordinary day against holiday."""
    miss = _miss()
    weekend = X.is_weekend("local")
    holiday = X.local_day("local").isin([h[0] for h in spec.holidays]) if spec.holidays else F.lit(False)
    stats = predictions.groupBy(*keys).agg(
        F.avg(F.when(~weekend, miss)).alias("weekday_mae"),
        F.avg(F.when(weekend, miss)).alias("weekend_mae"),
        F.count_if(~weekend).alias("n_weekday"),
        F.count_if(weekend).alias("n_weekend"),
        F.avg(F.when(~holiday, miss)).alias("ordinary_mae"),
        F.avg(F.when(holiday, miss)).alias("holiday_mae"),
        F.count_if(holiday).alias("n_holiday"),
    )
    return stats.withColumn("weekend_penalty", X.safe_div(F.col("weekend_mae"), F.col("weekday_mae"))).withColumn(
        "holiday_penalty", X.safe_div(F.col("holiday_mae"), F.col("ordinary_mae"))
    )


def residual_acf(predictions: DataFrame, n_lags: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Autocorrelation of the residuals with the 95 % white-noise bound; NULL when every residual is equal."""
    rows = predictions.select(*keys, "t_index", (F.col("observed") - F.col("predicted")).alias("residual"))
    products = lag_products(rows, n_lags, keys, "residual").filter(F.col("lag") <= F.col("n_rows") - 1)
    flat = F.col("lowest") == F.col("highest")
    return products.select(
        *keys,
        "lag",
        F.when(~flat, X.safe_div(F.col("product"), F.col("c0"))).alias("acf"),
        F.when(flat, F.lit(0.0)).otherwise(1.96 / F.sqrt(F.col("n_rows").cast("double"))).alias("confidence"),
    )


def _correlation_sums(predictions: DataFrame, max_lag: int, keys: Sequence[str], extra: dict | None = None) -> DataFrame:
    """Per key: the products of every lag as ``_c``, and whatever ``extra`` aggregates, in one pass.

    Each series' products for all lags come from one window; the shuffle carries only their sums.
    """
    means = predictions.groupBy(*keys).agg(F.avg("observed").alias("_mx"), F.avg("predicted").alias("_my"))
    kept = ["observed", "predicted", "persistence"] if extra else []
    centred = predictions.join(means, list(keys)).select(
        *keys, "t_index", *kept, (F.col("observed") - F.col("_mx")).alias("x"), (F.col("predicted") - F.col("_my")).alias("y")
    )
    lags = list(range(-max_lag, max_lag + 1))

    def build(w):
        shifted = {k: (F.lead("y", k) if k >= 0 else F.lag("y", -k)).over(w) for k in lags}
        cols = {f"p{i}": F.col("x") * shifted[k] for i, k in enumerate(lags)}
        return {**cols, "_step": F.abs(F.col("observed") - F.lag("observed", 1).over(w))} if extra else cols

    rows = over_series(centred, build, before=max_lag, after=max_lag, keys=keys)
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col("x") * F.col("x")).alias("_xx"),
        F.sum(F.col("y") * F.col("y")).alias("_yy"),
        *[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(lags))],
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    scale = F.sqrt(F.col("_xx") * F.col("_yy"))
    entries = [
        F.struct(F.lit(k).alias("lag"), X.safe_div(F.coalesce(F.col(f"p{i}"), F.lit(0.0)), scale).alias("correlation"))
        for i, k in enumerate(lags)
    ]
    return sums.select(*keys, F.array(*entries).alias("_c"), *(extra or {}))


def cross_correlation(predictions: DataFrame, max_lag: int = 12, keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of the forecast at ``t + lag`` with the observation at ``t``, normed on the full window."""
    return _correlation_sums(predictions, max_lag, keys).select(*keys, F.inline("_c"))


def _peak_columns() -> list[Column]:
    """Peak lag (the smallest among equals to nine digits) and the two lags the reading rests on."""
    usable = F.filter("_c", lambda e: e["correlation"].isNotNull())
    ordered = F.array_max(
        F.transform(usable, lambda e: F.struct(F.round(e["correlation"], 9).alias("r"), (-e["lag"]).alias("k"), e["correlation"].alias("c")))
    )
    at = lambda k: F.element_at(F.filter("_c", lambda e: e["lag"] == k), 1)["correlation"]
    return [
        F.coalesce(-ordered["k"], F.lit(0)).alias("peak_lag"),
        ordered["c"].alias("peak_correlation"),
        at(0).alias("lag0_correlation"),
        at(1).alias("lag1_correlation"),
        (at(1) - at(0)).alias("lag_margin"),
    ]


def copy_verdict(ratio: Column) -> Column:
    return F.when(ratio < COLLAPSED, "collapsed").when(ratio < NEAR, "near-persistence").otherwise("independent")


def copy_ratio(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distance from persistence over the series' own movement inside the window."""
    rows = over_series(
        predictions.select(*keys, "t_index", "observed", "predicted", "persistence"),
        lambda w: {"_step": F.abs(F.col("observed") - F.lag("observed", 1).over(w))},
        before=1,
        keys=keys,
    )
    return rows.groupBy(*keys).agg(
        X.safe_div(F.avg(F.abs(F.col("predicted") - F.col("persistence"))), F.avg("_step")).alias("copy_ratio")
    )


def copying_report(predictions: DataFrame, max_lag: int = 12, keys: Sequence[str] = KEYS) -> DataFrame:
    """Is the forecast more than its last input? The verdict rests on the copy ratio alone."""
    apart = F.avg(F.abs(F.col("predicted") - F.col("persistence")))
    extra = {"copy_ratio": X.safe_div(apart, F.avg("_step"))}
    sums = _correlation_sums(predictions, max_lag, keys, extra)
    return sums.select(*keys, *_peak_columns(), "copy_ratio", copy_verdict(F.col("copy_ratio")).alias("verdict"))


def lag1_copy_ratio(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same ratio with the step into the window counted as movement: there persistence is y(t-1)."""
    step = F.abs(F.col("observed") - F.col("persistence"))
    return predictions.groupBy(*keys).agg(
        X.safe_div(F.avg(F.abs(F.col("predicted") - F.col("persistence"))), F.avg(step)).alias("lag1_copy_ratio")
    )


def worst_windows(predictions: DataFrame, window: int, top: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``top`` worst non-overlapping windows by MAE, chosen greedily; equals (to nine digits) by start.

    The greedy choice is a fixed number of rounds, each one aggregate over the candidate windows and
    one equi-join that removes those overlapping a chosen one. Candidates and choices are written, so
    every round reads the windows once instead of repeating the rounds before it.
    """
    keys = list(keys)

    def build(w):
        ahead = w.rowsBetween(0, window - 1)
        return {
            "mae": F.avg(_miss()).over(ahead),
            "baseline_mae": F.avg(F.abs(F.col("observed") - F.col("persistence"))).over(ahead),
            "stop": F.last("local").over(ahead),
            "_len": F.count(F.lit(1)).over(ahead),
        }

    rows = over_series(
        predictions.select(*keys, "t_index", "local", "observed", "predicted", "persistence"), build, after=window - 1, keys=keys
    ).filter(F.col("_len") == window)
    cands = rows.select(*keys, F.col("t_index").alias("start_index"), F.col("local").alias("start"), "stop", "mae", "baseline_mae")
    cands = durable(cands, "windows")
    rank = F.struct(F.round("mae", 9), -F.col("start_index"))
    chosen = None
    for place in range(1, top + 1):
        left = cands
        if chosen is not None:
            taken = chosen.groupBy(*keys).agg(F.collect_list("start_index").alias("_taken"))  # at most top entries
            left = cands.join(taken, keys).filter(
                F.forall("_taken", lambda s: F.abs(s - F.col("start_index")) >= window)
            )
        best = (
            left.groupBy(*keys)
            .agg(F.max_by(F.struct("start_index", "start", "stop", "mae", "baseline_mae"), rank).alias("b"))
            .select(*keys, F.lit(place).alias("place"), "b.*")
        )
        if place < top:
            best = durable(best, "chosen")
        chosen = best if chosen is None else chosen.unionByName(best)
    return chosen.withColumn("n_steps", F.lit(window)).withColumn(
        "ratio_to_persistence", X.safe_div(F.col("mae"), F.col("baseline_mae"))
    )


def worst_windows_report(windows: DataFrame, baselines: Sequence[str] = ("persistence", "seasonal_naive"), top: int = 12) -> DataFrame:
    """Windows of fitted models only, those worst against persistence first."""
    rows = windows.filter(~F.col("model").isin(list(baselines)))
    return rows.orderBy(
        F.round("ratio_to_persistence", 9).desc_nulls_last(), "area", "split", "model", "start_index"
    ).limit(top)


def cross_area_mase(scores: DataFrame, areas: Sequence[int]) -> DataFrame:
    """One row per model: MASE of the named areas as columns, and mean, worst and count over all areas.

    A model with several seeds enters with its mean over them in each area.
    """
    scores = scores.groupBy("area", "model").agg(F.avg("mase").alias("mase"))
    named = [F.max(F.when(F.col("area") == a, F.col("mase"))).alias(f"mase_{a}") for a in areas]
    table = scores.groupBy("model").agg(
        *named,
        F.avg("mase").alias("mase_mean"),
        F.max("mase").alias("mase_worst"),
        F.count("mase").alias("n_areas"),
    )
    return table.orderBy(F.asc_nulls_last("mase_mean"))
