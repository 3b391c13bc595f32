"""One-step-ahead baselines and the contract every forecaster keeps.

A forecaster's ``fit`` turns training rows into a model table and its ``predict`` turns the whole
panel and that table into ``predicted`` for every step. ``walk_forward`` restricts the result to a
split afterwards: cutting the panel to the split before the window functions run would drop the
history, so only rows beyond the forecaster's reach are left out beforehand.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators.quality import PanelError
from cellpulse.plans.series import over_series
from cellpulse.settings import PanelSpec


class Forecaster(Protocol):
    name: str
    reach: int

    def fit(self, labelled: DataFrame) -> DataFrame | None: ...

    def predict(self, labelled: DataFrame, model: DataFrame | None) -> DataFrame: ...


@dataclass(frozen=True)
class Naive:
    """The value ``lag`` steps earlier: persistence for lag 1, seasonal naive for a season."""

    name: str
    lag: int

    @property
    def reach(self) -> int:
        return self.lag

    def fit(self, labelled: DataFrame) -> None:
        return None

    def predict(self, labelled: DataFrame, model: DataFrame | None = None) -> DataFrame:
        return over_series(labelled, lambda w: {"predicted": F.lag("value", self.lag).over(w)}, before=self.lag)


def persistence() -> Naive:
    return Naive("persistence", 1)


def seasonal_naive(spec: PanelSpec) -> Naive:
    return Naive("seasonal_naive", spec.daily)


def with_reach(labelled: DataFrame, spec: PanelSpec, splits: Sequence[str], reach: int) -> DataFrame:
    """The rows of some splits and at least ``reach`` steps before them; the rest is never read.

    Step numbers follow from dates; a day on either side covers any offset of the local zone.
    """
    parts = [spec.split(name) for name in splits]
    first = min((p.start - spec.start).days for p in parts) * spec.daily
    last = (max((p.end - spec.start).days for p in parts) + 1) * spec.daily
    first, last = first - spec.daily - reach, last + spec.daily
    rows = labelled.filter(F.col("t_index").between(first, last))
    if "date" not in labelled.columns:
        return rows
    # the same range in whole days, wider by one for the zone: a stored panel is then read for these dates only
    days = (spec.start + dt.timedelta(days=first // spec.daily - 1), spec.start + dt.timedelta(days=last // spec.daily + 1))
    return rows.filter(F.col("date").between(F.lit(days[0]), F.lit(days[1])))


def walk_forward(
    forecaster: Forecaster, labelled: DataFrame, spec: PanelSpec, split: str, model: DataFrame | None = None
) -> DataFrame:
    """Forecasts of one split, each made from the true values before it.

    The panel is cut to the split plus the forecaster's ``reach``, not to the split itself. Every step of the split
    has its row, with a NULL where no forecast was possible, and ``persistence`` beside it for the diagnostics.
    """
    rows = with_reach(labelled, spec, [split], max(1, forecaster.reach))
    rows = over_series(rows, lambda w: {"persistence": F.lag("value", 1).over(w)}, before=1)
    return forecaster.predict(rows, model).filter(F.col("split") == split).select(
        "area",
        "split",
        F.lit(forecaster.name).alias("model"),
        F.lit(getattr(forecaster, "seed", 0)).alias("seed"),
        "t_index",
        "local",
        F.col("value").alias("observed"),
        "persistence",
        "predicted",
    )


def need_history(forecasts: DataFrame) -> DataFrame:
    """Rows of a split without a forecast because the panel holds too little history; must be empty."""
    return forecasts.filter("predicted is null")


def baseline_predictions(
    labelled: DataFrame, spec: PanelSpec, splits: tuple[str, ...] = ("test", "stress"), blends: tuple[float, ...] = ()
) -> DataFrame:
    """Long predictions of both baselines (and of weighted blends, one per seed) from one window pass.

    ``persistence`` rides along as a column, because the diagnostics compare against it.
    """
    rows = over_series(
        with_reach(labelled, spec, splits, spec.daily).select("area", "t_index", "local", "split", "value"),
        lambda w: {"_p": F.lag("value", 1).over(w), "_s": F.lag("value", spec.daily).over(w)},
        before=spec.daily,
    ).filter(F.col("split").isin(list(splits)))
    kinds = [("persistence", 0, F.col("_p")), ("seasonal_naive", 0, F.col("_s"))]
    kinds += [("blend", i, F.col("_p") * w + F.col("_s") * (1 - w)) for i, w in enumerate(blends)]
    entries = [F.struct(F.lit(m).alias("model"), F.lit(i).alias("seed"), p.alias("predicted")) for m, i, p in kinds]
    return rows.select(
        "area", "split", "t_index", "local", F.col("value").alias("observed"), F.col("_p").alias("persistence"),
        F.inline(F.array(*entries)),
    )


def seed_ensemble(predictions: DataFrame, model: str, suffix: str = "_ensemble") -> DataFrame:
    """Mean of the seeds' forecasts at every step, as a model of its own."""
    members = predictions.filter(F.col("model") == model)
    return members.groupBy("area", "split", "t_index", "local").agg(
        F.lit(model + suffix).alias("model"),
        F.lit(0).alias("seed"),
        F.first("observed").alias("observed"),
        F.first("persistence").alias("persistence"),
        F.avg("predicted").alias("predicted"),
        F.count(F.lit(1)).alias("n_members"),
    )


def ensemble_cost(member_rows: DataFrame, suffix: str = "_ensemble") -> DataFrame:
    """An ensemble needs every member fitted and run, so costs and parameters are summed."""
    return member_rows.groupBy("area", "split", "model").agg(
        F.sum("train_wall_s").alias("train_wall_s"),
        F.sum("inference_wall_s").alias("inference_wall_s"),
        F.sum("n_params").alias("n_params"),
        F.count(F.lit(1)).alias("n_members"),
    ).withColumn("model", F.concat("model", F.lit(suffix)))


def merge_selections(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by model: new selections replace old ones of the same model.

    Selections tuned on different areas must not be mixed; one count on each side decides.
    """
    areas = [r[0] for r in kept.select("tuning_area").unionByName(fresh.select("tuning_area")).distinct().limit(2).collect()]
    if len(areas) > 1:
        raise PanelError(f"selections were tuned on different areas: {sorted(areas)}")
    return kept.join(fresh.select("model").distinct(), "model", "left_anti").unionByName(fresh)


def information_criteria(fits: DataFrame) -> DataFrame:
    """AIC, BIC and AICc from ``rss``, ``n`` and ``k`` of a Gaussian fit."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    fit = n * (F.log(F.lit(2 * 3.141592653589793) * F.col("rss") / n) + 1)
    aic = fit + 2 * k
    room = n - k - 1
    return fits.select(
        "*",
        aic.alias("aic"),
        (fit + k * F.log(n)).alias("bic"),
        F.when(room > 0, aic + X.safe_div(2 * k * (k + 1), room)).otherwise(F.lit(float("inf"))).alias("aicc"),
    )
