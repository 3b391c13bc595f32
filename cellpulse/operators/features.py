"""Chronological splits and leak-free features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators.quality import PanelError
from cellpulse.plans.series import over_series
from cellpulse.settings import PanelSpec

# --- splits --------------------------------------------------------------------------------------


def assign_split(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Label each row by its local date. The few ranges are compared in place, so nothing is joined."""
    return panel.withColumn("split", X.split_label(X.local_day("local"), spec.splits))


def check_splits(labelled: DataFrame, spec: PanelSpec) -> DataFrame:
    """Steps per split against days x daily period, and whether each split follows the one before."""
    # one row per step first: every area carries the same calendar
    steps = labelled.filter("split is not null").groupBy("split", "t_index").agg(F.count(F.lit(1)).alias("_areas"))
    seen = steps.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_steps"), F.min("t_index").alias("first_index"), F.max("t_index").alias("last_index")
    )
    expected = F.create_map(*[F.lit(v) for p in spec.splits for v in (p.name, p.days * spec.daily)])
    w = Window.orderBy("first_index")  # one row per split
    return seen.select(
        "*",
        expected[F.col("split")].cast("long").alias("expected_steps"),
        (F.col("n_steps") == expected[F.col("split")]).alias("complete"),
        F.coalesce(F.col("first_index") == F.lag("last_index").over(w) + 1, F.lit(True)).alias("contiguous"),
    )


def fit_rows(labelled: DataFrame, names: Sequence[str] = ("train", "validation")) -> DataFrame:
    """Rows the final refit may see; the test split cannot be asked for."""
    if {"test", "stress"} & set(names):
        raise PanelError("a final fit must not see the test or stress split")
    return labelled.filter(F.col("split").isin(list(names)))


# --- scaling -------------------------------------------------------------------------------------


def scaler_fit(train: DataFrame, value: str = "value") -> DataFrame:
    """Mean and population standard deviation of log1p per area; give it the train rows only.

    An area without data, with a negative value or with a constant series cannot be scaled and fails the query;
    ``scaler_violations`` lists such areas beforehand.
    """
    logged = F.log1p(F.when(F.col(value) < 0, F.raise_error(_told("area %s holds a negative value"))).otherwise(F.col(value)))
    flat = F.count(value).isin(0) | (F.min(value) == F.max(value))
    std = F.when(flat, F.raise_error(_told("area %s is empty or constant and cannot be scaled"))).otherwise(F.stddev_pop(logged))
    return train.groupBy("area").agg(F.avg(logged).alias("log_mean"), std.alias("log_std"), F.count(value).alias("n_fitted"))


def _told(text: str) -> Column:
    return F.format_string(text, F.col("area").cast("string"))


def _with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics beside each row; a row of an area that has none fails the query rather than vanish."""
    known = rows.join(stats, "area", "left")
    return known.withColumn("log_std", F.coalesce("log_std", F.raise_error(_told("area %s has no scaling statistics"))))


def scaler_violations(train: DataFrame, value: str = "value") -> DataFrame:
    """Areas that cannot be scaled: no data, a negative value, or a constant series."""
    stats = train.groupBy("area").agg(
        F.count(value).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    reason = (
        F.when(F.col("n") == 0, "empty").when(F.col("lowest") < 0, "negative").when(F.col("lowest") == F.col("highest"), "constant")
    )
    return stats.withColumn("reason", reason).filter("reason is not null").select("area", "reason")


def scaler_transform(rows: DataFrame, stats: DataFrame, value: str = "value", out: str = "scaled", keep_stats: bool = False) -> DataFrame:
    """(log1p(x) - mean) / std per area. The join side is one row per area; Catalyst sizes it."""
    z = X.safe_div(F.log1p(value) - F.col("log_mean"), F.col("log_std"))
    known = _with_stats(rows, stats).withColumn(out, z)
    return known if keep_stats else known.drop("log_mean", "log_std", "n_fitted")


def scaler_inverse(rows: DataFrame, stats: DataFrame, scaled: str = "scaled", out: str = "value") -> DataFrame:
    """max(0, expm1(z std + mean)); NULL stays NULL."""
    back = X.not_below_zero(F.expm1(F.col(scaled) * F.col("log_std") + F.col("log_mean")))
    return _with_stats(rows, stats).withColumn(out, back).drop("log_mean", "log_std", "n_fitted")


# --- features ------------------------------------------------------------------------------------


def calendar_features(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    cols = X.calendar_columns("local", [h[0] for h in spec.holidays])
    return rows.select("*", *[c.alias(n) for n, c in cols.items()])


def lag_columns(w, lags: Sequence[int], value: str = "value") -> dict[str, Column]:
    return {f"lag_{k}": F.lag(value, k).over(w) for k in lags}


def rolling_columns(w, windows: Sequence[int], value: str = "value") -> dict[str, Column]:
    """Mean and population standard deviation of the ``n`` values before t, never t itself.

    A NULL among them makes both NULL, as a lag would be. Short history at the start of a series is used as far as it goes.
    """
    out: dict[str, Column] = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        whole = F.count(value).over(frame) == F.count(F.lit(1)).over(frame)
        out[f"roll_mean_{n}"] = F.when(whole, F.avg(value).over(frame))
        out[f"roll_std_{n}"] = F.when(whole, F.stddev_pop(value).over(frame))
    return out


def history(spec: PanelSpec) -> int:
    return max([1, *spec.lags, *spec.rolling])


def lag_features(panel: DataFrame, spec: PanelSpec, value: str = "value") -> DataFrame:
    return over_series(panel, lambda w: lag_columns(w, spec.lags, value), before=max(spec.lags))


def rolling_features(panel: DataFrame, spec: PanelSpec, value: str = "value") -> DataFrame:
    return over_series(panel, lambda w: rolling_columns(w, spec.rolling, value), before=max(spec.rolling))


def feature_names(spec: PanelSpec, calendar: bool = True) -> list[str]:
    names = [f"lag_{k}" for k in spec.lags]
    for n in spec.rolling:
        names += [f"roll_mean_{n}", f"roll_std_{n}"]
    return names + (list(X.calendar_columns("local", [])) if calendar else [])


def design_matrix(panel: DataFrame, spec: PanelSpec, value: str = "value", calendar: bool = True) -> DataFrame:
    """All features for targets with full history. One shuffle and one sort carry every column."""
    need = history(spec)
    if need >= spec.n_steps:
        raise PanelError(f"{spec.n_steps} steps are too short for {need} steps of history")
    rows = over_series(
        panel, lambda w: {**lag_columns(w, spec.lags, value), **rolling_columns(w, spec.rolling, value)}, before=need
    ).filter(F.col("t_index") >= need)
    return calendar_features(rows, spec) if calendar else rows


def assembled(design: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one ML vector. ``complete`` tells rows without any NULL among them; no row is dropped."""
    whole = F.lit(True)
    for name in names:
        whole = whole & F.col(name).isNotNull()
    return VectorAssembler(inputCols=list(names), outputCol=out, handleInvalid="keep").transform(design.withColumn("complete", whole))


def sliding_windows(
    panel: DataFrame, length: int, horizon: int = 1, value: str = "value", keep_short: bool = False
) -> DataFrame:
    """The ``length`` values that end ``horizon`` steps before each target, as an array.

    Targets with less history, or with a NULL in it, are left out; with ``keep_short`` they stay, with a NULL window.
    """
    if length < 1 or horizon < 1:
        raise PanelError("window length and horizon must be at least 1")
    reach = length + horizon - 1

    def build(w):
        return {"window": F.collect_list(value).over(w.rowsBetween(-reach, -horizon))}

    rows = over_series(panel, build, before=reach)
    if keep_short:
        return rows.withColumn("window", F.when(F.size("window") == length, F.col("window")))
    return rows.filter(F.size("window") == length)


def window_exog(windows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Known-in-advance features of the target time, repeated along the window."""
    return windows.withColumn("exog", F.array_repeat(F.struct(*names), F.size("window")))


def fourier_terms(rows: DataFrame, periods: dict[int, int]) -> DataFrame:
    return rows.select("*", *[c.alias(n) for n, c in X.fourier_columns("t_index", periods).items()])


def causality_audit(panel: DataFrame, spec: PanelSpec, cut: int, value: str = "value") -> DataFrame:
    """Features before ``cut`` that change when every value from ``cut`` on is changed; must be empty."""
    names = ["area", "t_index", *feature_names(spec)]
    changed = panel.withColumn(value, F.when(F.col("t_index") >= cut, F.col(value) * -7.0 + 1000.0).otherwise(F.col(value)))
    before = design_matrix(panel, spec, value).filter(F.col("t_index") <= cut).select(*names)
    after = design_matrix(changed, spec, value).filter(F.col("t_index") <= cut).select(*names)
    return before.exceptAll(after)
