"""Fitted one-step-ahead forecasters over all areas at once.

The harmonic model keeps one coefficient row per area, estimated from sums Spark has already added
up. The tree and window models are pooled: one Spark ML model over the standardised rows of every
area, so that training parallelises over the data and not over a driver loop. None of them is the
estimator of the study they stand in for, so their numbers are only comparable with the baselines.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators import features as FE
from cellpulse.operators import forecast as FC
from cellpulse.operators import metrics as M
from cellpulse.operators.panel import PLACED_STEPS
from cellpulse.operators.series import column, key_columns
from cellpulse.plans.dims import literal_table
from cellpulse.plans.series import over_series, spread, with_halo
from cellpulse.plans.storage import durable
from cellpulse.settings import PanelSpec

TRAIN = ("train",)
REFIT = ("train", "validation")


# --- harmonic regression with autoregressive errors ------------------------------------------------


def _angles(t: np.ndarray, periods: Mapping[int, int]) -> np.ndarray:
    """Constant, then sin and cos of every harmonic; the column order of ``fourier_columns``."""
    cols = [np.ones(len(t))]
    for period, order in periods.items():
        phase = (t % period) * (2.0 * np.pi / period)
        for k in range(1, order + 1):
            cols += [np.sin(phase * k), np.cos(phase * k)]
    return np.column_stack(cols)


def harmonic_sums(t: np.ndarray, y: np.ndarray, own: np.ndarray, periods: Mapping[int, int], p: int):
    """Cross products of (regressors, y): within a step for all own rows, and between a step and its
    ``p`` predecessors for the own rows that have them."""
    v = np.column_stack([_angles(t, periods), y])
    now = v[own]
    at = np.flatnonzero(own)
    at = at[at >= p]
    at = at[t[at] - t[at - p] == p]
    stacked = np.concatenate([v[at - i] for i in range(p + 1)], axis=1) if len(at) else np.zeros((0, v.shape[1] * (p + 1)))
    return now.T @ now, stacked.T @ stacked, len(now), len(at)


def harmonic_solve(level: np.ndarray, cross: np.ndarray, p: int):
    """Regression coefficients, then the AR coefficients of its residuals, from the summed products."""
    beta = np.linalg.lstsq(level[:-1, :-1], level[:-1, -1], rcond=None)[0]
    c = np.append(-beta, 1.0)  # residual = (regressors, y) . c
    if p == 0:
        return beta, np.zeros(0), float(c @ level @ c)
    phi, rss = ar_solve(residual_products(c, cross, p), p)
    return beta, phi, rss


def residual_products(c: np.ndarray, cross: np.ndarray, p: int) -> np.ndarray:
    """Products of the residuals ``(regressors, y) . c`` of a step and its ``p`` predecessors."""
    w = len(c)
    return (cross.reshape(p + 1, w, p + 1, w) @ c).transpose(0, 2, 1) @ c


def ar_solve(e: np.ndarray, p: int) -> tuple[np.ndarray, float]:
    """Autoregressive coefficients of order ``p`` and the sum of squares that is left; a lower order is a corner of a higher one's products."""
    e = e[: p + 1, : p + 1]
    phi = np.linalg.lstsq(e[1:, 1:], e[1:, 0], rcond=None)[0]
    return phi, max(0.0, float(e[0, 0] - 2 * phi @ e[1:, 0] + phi @ e[1:, 1:] @ phi))


def harmonic_products(
    labelled: DataFrame, spec: PanelSpec, periods: Mapping[int, int], p: int, fit_on: Sequence[str], solve: Callable[[np.ndarray, np.ndarray, int], dict], schema: str
) -> DataFrame:
    """What ``solve`` makes of the products of ``harmonic_sums`` and the number of rows in them, per area, from one pass.

    Up to ``PLACED_STEPS`` an area is solved where it lies; of longer series the products of chunks are shuffled and added.
    """
    rows = labelled.filter(F.col("split").isin(list(fit_on)) & F.col("value").isNotNull()).select("area", "t_index", F.log1p("value").alias("y"))
    listed = pa.list_(pa.float64())

    def products(part: pa.Table, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        level, cross, n, n_cross = harmonic_sums(column(part, "t_index"), column(part, "y"), own, periods, p)
        return level, cross, n_cross if p else n

    def solved(group: tuple, level: np.ndarray, cross: np.ndarray, n: int) -> pa.Table:
        columns = solve(level, cross, n)
        return pa.table({**key_columns(("area",), group, len(next(iter(columns.values())))), **columns})

    def whole(group: tuple, part: pa.Table) -> pa.Table:
        return solved(group, *products(part.sort_by("t_index"), np.ones(len(part), bool)))

    if spec.n_steps <= PLACED_STEPS:
        return rows.groupBy("area").applyInArrow(whole, schema)

    def sums(group: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("t_index")
        level, cross, n = products(part, column(part, "_home").astype(bool))
        lists = {"level": pa.array([level.ravel()], type=listed), "cross": pa.array([cross.ravel()], type=listed)}
        return pa.table({**key_columns(("area",), group, 1), **lists, "n": pa.array([n], type=pa.int64())})

    def added(group: tuple, part: pa.Table) -> pa.Table:
        return solved(group, *_summed(part), int(column(part, "n").sum()))

    partial = spread(with_halo(rows, before=p), "area", "_chunk").groupBy("area", "_chunk").applyInArrow(sums, "area long, level array<double>, cross array<double>, n long")
    return spread(partial, "area").groupBy("area").applyInArrow(added, schema)


def _summed(part: pa.Table) -> list[np.ndarray]:
    """The products of all chunks added up, as square matrices."""
    flat = [part.column(c).combine_chunks().flatten().to_numpy().reshape(len(part), -1).sum(axis=0) for c in ("level", "cross")]
    return [m.reshape(int(round(len(m) ** 0.5)), -1) for m in flat]


@dataclass(frozen=True)
class Harmonic:
    """Fourier regression of log1p, then an AR(p) on its residuals, one coefficient row per area.

    Least squares with an intercept does not depend on the scale, so the standardisation the other
    models need is left out. One pass over the panel gives the products both stages are solved from.
    """

    spec: PanelSpec
    k_daily: int = 4
    k_weekly: int = 2
    ar: int = 3
    fit_on: tuple[str, ...] = TRAIN
    name: str = "harmonic"

    @property
    def periods(self) -> dict[int, int]:
        return {self.spec.daily: self.k_daily, self.spec.weekly: self.k_weekly}

    def fit(self, labelled: DataFrame) -> DataFrame:
        """One row per area: ``beta``, ``phi``, residual sum of squares, rows used, parameters."""
        listed = pa.list_(pa.float64())
        p = self.ar

        def solve(level: np.ndarray, cross: np.ndarray, n: int) -> dict:
            beta, phi, rss = harmonic_solve(level, cross, p)
            return {"beta": pa.array([beta], type=listed), "phi": pa.array([phi], type=listed), "rss": pa.array([rss]), "n": pa.array([n], type=pa.int64())}

        schema = "area long, beta array<double>, phi array<double>, rss double, n long"
        fitted = harmonic_products(labelled, self.spec, self.periods, p, self.fit_on, solve, schema)
        return fitted.withColumn("k", F.size("beta") + F.size("phi") + 1)

    def predict(self, labelled: DataFrame, model: DataFrame) -> DataFrame:
        """x(t) beta plus phi-weighted residuals of the true past, back in original units."""
        rows = labelled.join(model.select("area", "beta", "phi"), "area", "left")
        terms = [F.lit(1.0), *X.fourier_columns("t_index", self.periods).values()]
        fit = sum((F.get("beta", F.lit(i)) * c for i, c in enumerate(terms)), F.lit(0.0))
        weights = [F.get("phi", F.lit(i)).alias(f"_phi{i}") for i in range(self.ar)]
        rows = rows.select(*labelled.columns, fit.alias("_fit"), *weights).withColumn("_e", F.log1p("value") - F.col("_fit"))

        def build(w):
            carried = sum((F.col(f"_phi{i}") * F.lag("_e", i + 1).over(w) for i in range(self.ar)), F.lit(0.0))
            return {"predicted": X.not_below_zero(F.expm1(F.col("_fit") + carried))}

        return over_series(rows, build, before=max(1, self.ar)).select(*labelled.columns, "predicted")

    @property
    def reach(self) -> int:
        return max(1, self.ar)

    def complexity(self, model: DataFrame) -> DataFrame:
        return model.select("area", F.lit(self.name).alias("model"), F.col("k").cast("long").alias("n_params"))


# --- pooled models on standardised features --------------------------------------------------------


@dataclass(frozen=True)
class Pooled:
    """A fitted Spark ML model with the scaling it was fitted on; scoring needs no train rows any more."""

    model: object
    stats: DataFrame


def _statistics(labelled: DataFrame) -> DataFrame:
    """One row per area, written, because fit and scoring both read it."""
    return durable(FE.scaler_fit(labelled.filter("split = 'train'")), "scaling")


def _to_units(scored: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows; a target whose history is short or holds a NULL has no forecast."""
    rows = scored.select(*columns, F.when(F.col("complete"), F.col("prediction")).alias("_prediction"))
    return FE.scaler_inverse(rows, stats, scaled="_prediction", out="predicted").drop("_prediction")


def _learnable(design: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Rows of the splits that have a target and a whole history."""
    return design.filter(F.col("split").isin(sorted(splits)) & F.col("complete") & F.col("scaled").isNotNull())


@dataclass(frozen=True)
class BoostedTrees:
    """Gradient-boosted trees with absolute loss on the causal design matrix.

    Trained on train; with ``early_stop`` the validation rows decide when adding trees stops.
    """

    spec: PanelSpec
    trees: int = 20
    depth: int = 5
    step: float = 0.1
    subsample: float = 0.8
    min_rows: int = 20
    seed: int = 0
    early_stop: bool = True
    calendar: bool = True
    fit_on: tuple[str, ...] = TRAIN
    name: str = "boosted_trees"

    @property
    def columns(self) -> list[str]:
        return FE.feature_names(self.spec, self.calendar)

    def design(self, labelled: DataFrame, stats: DataFrame) -> DataFrame:
        """Every step with its features; a NULL stays in its place, so that lags keep their distance."""
        rows = FE.scaler_transform(labelled, stats)
        return FE.assembled(FE.design_matrix(rows, self.spec, "scaled", self.calendar), self.columns)

    @property
    def reach(self) -> int:
        return FE.history(self.spec)

    def fit(self, labelled: DataFrame) -> Pooled:
        return fit_trees([self], labelled)[0]

    def vectors(self, labelled: DataFrame, stats: DataFrame) -> DataFrame:
        """The rows to learn from, and those that decide when to stop."""
        seen = {*self.fit_on, *(("validation",) if self.early_stop else ())}
        return _learnable(self.design(labelled, stats), seen).select(
            "features", F.col("scaled").alias("label"), (~F.col("split").isin(list(self.fit_on))).alias("held_out")
        )

    def learn(self, vectors: DataFrame) -> object:
        learner = GBTRegressor(
            featuresCol="features", labelCol="label", lossType="absolute", maxIter=self.trees, maxDepth=self.depth,
            stepSize=self.step, subsamplingRate=self.subsample, minInstancesPerNode=self.min_rows, seed=self.seed,
        )
        if self.early_stop:
            learner = learner.setParams(validationIndicatorCol="held_out", validationTol=0.001)
        return learner.fit(vectors)

    def predict(self, labelled: DataFrame, model: Pooled) -> DataFrame:
        return _to_units(model.model.transform(self.design(labelled, model.stats)), model.stats, labelled.columns)

    def importance(self, spark: SparkSession, model: Pooled, top: int | None = None) -> DataFrame:
        """Normalised gain per feature, largest first: all of them, or the first ``top``."""
        values = model.model.featureImportances.toArray()
        rows = sorted(zip(self.columns, map(float, values)), key=lambda r: (-r[1], r[0]))[:top]
        return literal_table(spark, rows, ("feature", "importance"), ("string", "double"))

    def complexity(self, spark: SparkSession, model: Pooled) -> DataFrame:
        trees, nodes = int(model.model.getNumTrees), int(model.model.totalNumNodes)
        row = (self.name, trees, nodes, (nodes + trees) // 2)
        return literal_table(spark, [row], ("model", "n_trees", "n_nodes", "n_leaves"), ("string", "int", "long", "long"))


def fit_trees(learners: Sequence[BoostedTrees], labelled: DataFrame) -> list[Pooled]:
    """Each learner fitted; those of the same rows and features share the scaling and one stored table."""
    stats, stored, out = _statistics(labelled), {}, []
    for m in learners:
        key = (m.spec, m.calendar, tuple(m.fit_on), m.early_stop)
        if key not in stored:
            # every pass of the learner reads the rows again, in the partitions of the panel: a stored table is cut by its bytes, of which
            # these rows have few, and a task would hold the more rows the larger the table
            stored[key] = m.vectors(labelled, stats).persist(StorageLevel.DISK_ONLY)
        out.append(Pooled(m.learn(stored[key]), stats))
    for vectors in stored.values():
        vectors.unpersist()
    return out


def tree_scores(candidates: Sequence[tuple[str, BoostedTrees]], labelled: DataFrame, spec: PanelSpec, stage: str = "trees", split: str = "validation") -> DataFrame:
    """``tune_grid`` for trees on the same features: one stored table to fit from, and one pass over the split that scores all of them."""
    first = candidates[0][1]
    if any((m.spec, m.calendar) != (first.spec, first.calendar) for _, m in candidates):
        return tune_grid(candidates, labelled, spec, stage)
    fitted = fit_trees([m for _, m in candidates], labelled)
    design = first.design(FC.with_reach(labelled, spec, [split], first.reach), fitted[0].stats).filter(F.col("split") == split)
    for k, found in enumerate(fitted):
        design = found.model.copy({found.model.predictionCol: f"_p{k}"}).transform(design)
    each = [F.struct(F.lit(label).alias("candidate"), F.lit(m.name).alias("model"), F.col(f"_p{k}").alias("prediction")) for k, (label, m) in enumerate(candidates)]
    scored = _to_units(design.select("area", "value", "complete", F.inline(F.array(*each))), fitted[0].stats, ["area", "value", "candidate", "model"])
    return scored.groupBy("candidate", "model").agg(*_errors("value")).orderBy(F.asc_nulls_last("valid_mae"), "candidate")


@dataclass(frozen=True)
class WindowRegression:
    """The target on its previous ``length`` values and the calendar of the target time."""

    spec: PanelSpec
    length: int = 24
    reg: float = 0.001
    mix: float = 0.5
    calendar: bool = True
    fit_on: tuple[str, ...] = TRAIN
    name: str = "window_regression"

    def design(self, labelled: DataFrame, stats: DataFrame) -> DataFrame:
        rows = FE.scaler_transform(labelled, stats)
        windows = FE.sliding_windows(rows, self.length, value="scaled", keep_short=True)
        windows = windows.withColumn("complete", F.col("window").isNotNull())
        # the learner wants numbers; such rows are neither learnt from nor forecast
        inputs = F.coalesce("window", F.array_repeat(F.lit(0.0), self.length))
        if self.calendar:
            windows = FE.calendar_features(windows, self.spec)
            inputs = F.concat(inputs, F.array(*X.calendar_columns("local", [])))
        return windows.withColumn("features", array_to_vector(inputs))

    @property
    def reach(self) -> int:
        return self.length

    def fit(self, labelled: DataFrame) -> Pooled:
        stats = _statistics(labelled)
        return self.solve(labelled.sparkSession, window_products(labelled, self.spec, stats, [self.length], self.fit_on), stats)

    def solve(self, spark: SparkSession, products: WindowProducts, stats: DataFrame) -> Pooled:
        """The learner on a few weighted rows that have the means and products of all rows, which are all that it goes by.

        They are centred, so the means come back with the intercept.
        """
        total = products.of(self.length, self.calendar)
        n = total[0, 0]
        mean = total[0, 1:] / n
        spread_out, directions = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
        steps = (directions * np.sqrt(np.maximum(spread_out, 0.0) * len(mean))).T
        flat = np.diag(total)[1:] / n - mean**2 <= 1e-12 * np.diag(total)[1:] / n
        steps[:, flat] = 0.0
        rows = [(Vectors.dense(x[:-1]), float(x[-1]), float(n / (2 * len(mean)))) for x in np.concatenate((steps, -steps))]
        few = spark.createDataFrame(rows, ["features", "label", "weight"]).coalesce(1)
        model = LinearRegression(regParam=self.reg, elasticNetParam=self.mix, solver="auto", weightCol="weight").fit(few)
        return Pooled(Linear(model.coefficients.toArray(), float(model.intercept + mean[-1] - model.coefficients.dot(mean[:-1]))), stats)

    def predict(self, labelled: DataFrame, model: Pooled) -> DataFrame:
        return _to_units(model.model.transform(self.design(labelled, model.stats)), model.stats, labelled.columns)

    def complexity(self, spark: SparkSession, model: Pooled) -> DataFrame:
        return literal_table(spark, [(self.name, len(model.model.coefficients) + 1)], ("model", "n_params"), ("string", "long"))


@dataclass(frozen=True)
class Linear:
    """Coefficients of the inputs and an intercept."""

    coefficients: np.ndarray
    intercept: float

    def transform(self, design: DataFrame) -> DataFrame:
        products = F.zip_with(vector_to_array("features"), F.lit(self.coefficients.tolist()), lambda x, c: x * c)
        return design.withColumn("prediction", F.aggregate(products, F.lit(self.intercept), lambda a, x: a + x))


@dataclass(frozen=True)
class WindowProducts:
    """Summed products of (1, window, calendar, target) for each length, of the rows whose known history has that length but not the next longer one."""

    lengths: tuple[int, ...]
    sums: np.ndarray

    def of(self, length: int, calendar: bool) -> np.ndarray:
        """The products of the rows with at least ``length`` known values, for the inputs that a model of that length has."""
        longest, width = self.lengths[-1], self.sums.shape[-1]
        mine = [0, *range(1 + longest - length, 1 + longest), *(range(1 + longest, width - 1) if calendar else ()), width - 1]
        return self.sums[self.lengths.index(length) :].sum(axis=0)[np.ix_(mine, mine)]


# The names of ``calendar_columns``, which cannot be asked for where a task loads this module.
_CALENDAR = ("sin_minute_of_day", "cos_minute_of_day", "sin_day_of_week", "cos_day_of_week", "is_weekend", "is_holiday")


def _in_order(labelled: DataFrame, spec: PanelSpec, stats: DataFrame, reach: int) -> DataFrame:
    """Scaled rows in order of time within area and chunk, with their place there, as a task of ``_windows`` wants them."""
    rows = FE.calendar_features(FE.scaler_transform(labelled, stats, keep_stats=True), spec)
    rows = rows.select("area", "t_index", "split", "value", "scaled", "log_mean", "log_std", *_CALENDAR)
    w = Window.partitionBy("area", "_chunk").orderBy("t_index")
    return with_halo(rows, before=reach).withColumn("_at", F.row_number().over(w)).drop("area", "t_index", "_chunk")


def _windows(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with the ``reach`` scaled values before each row, how many of them, counted back, are known, and the calendar.

    Only the last ``reach`` values are carried from batch to batch, so a series may be as long as it likes.
    """
    past, lost = np.zeros(reach), np.ones(reach, bool)
    for batch in batches:
        if not len(batch):
            continue
        part = pa.Table.from_batches([batch])
        missing = part.column("scaled").is_null().to_numpy()
        values = np.concatenate((past, np.where(missing, 0.0, column(part, "scaled"))))
        none = np.concatenate((lost, missing))
        before = np.arange(reach - 1, len(values) - 1)
        last = np.maximum.accumulate(np.where(none, np.arange(len(none)), -1))[before]
        known = np.minimum(np.minimum(before - last, column(part, "_at") - 1), reach)
        yield part, np.lib.stride_tricks.sliding_window_view(values, reach)[:-1], known, np.column_stack([column(part, c) for c in _CALENDAR])
        past, lost = values[-reach:], none[-reach:]


def window_products(labelled: DataFrame, spec: PanelSpec, stats: DataFrame, lengths: Sequence[int], fit_on: Sequence[str]) -> WindowProducts:
    """What every window model up to the longest of ``lengths`` is fitted from, in one pass; a task sends its sums only."""
    lengths = sorted(set(lengths))
    longest, width = lengths[-1], lengths[-1] + len(_CALENDAR) + 2
    bounds = [*lengths, longest + 1]
    splits = sorted(fit_on)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(lengths), width, width))
        for part, window, known, calendar in _windows(batches, longest):
            own = column(part, "_home") & part.column("scaled").is_valid().to_numpy() & np.isin(column(part, "split"), splits)
            for k, length in enumerate(lengths):
                at = np.flatnonzero(own & (known >= length) & (known < bounds[k + 1]))
                if len(at):
                    rows = np.column_stack((np.ones(len(at)), window[at, longest - length :], calendar[at], column(part, "scaled")[at]))
                    mine = np.array([0, *range(1 + longest - length, width)])
                    total[k][np.ix_(mine, mine)] += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    some = FC.with_reach(labelled, spec, splits, longest)
    partial = _in_order(some, spec, stats, longest).mapInArrow(sums, "sums array<double>")
    added = partial.select(F.posexplode("sums").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x"))
    flat = added.collect()  # as many rows as the matrices have cells
    out = np.zeros(len(lengths) * width * width)
    out[[r["place"] for r in flat]] = [r["x"] for r in flat]
    return WindowProducts(tuple(lengths), out.reshape(len(lengths), width, width))


def window_scores(fitted: Sequence[tuple[str, WindowRegression, Pooled]], labelled: DataFrame, spec: PanelSpec, stats: DataFrame, split: str = "validation") -> DataFrame:
    """The errors of all fitted window models, one row per candidate, from one pass over the split."""
    many, longest = len(fitted), max(m.length for _, m, _ in fitted)
    lengths = np.array([m.length for _, m, _ in fitted])
    weights = np.zeros((longest + len(_CALENDAR), many))
    for k, (_, m, found) in enumerate(fitted):
        inputs = [*range(longest - m.length, longest), *(range(longest, len(weights)) if m.calendar else ())]
        weights[inputs, k] = found.model.coefficients
    bases = np.array([found.model.intercept for _, _, found in fitted])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, many))
        for part, window, known, calendar in _windows(batches, longest):
            own = column(part, "_home") & (column(part, "split") == split)
            scale = [column(part, c)[own][:, None] for c in ("log_std", "log_mean")]
            observed = part.column("value").is_valid().to_numpy()[own][:, None]
            made = known[own][:, None] >= lengths
            scaled = np.concatenate((window[own], calendar[own]), axis=1) @ weights + bases
            gap = np.maximum(np.expm1(scaled * scale[0] + scale[1]), 0.0) - column(part, "value")[own][:, None]
            both = np.where(made & observed, gap, 0.0)
            total += [np.abs(both).sum(axis=0), (both**2).sum(axis=0), (made & observed).sum(axis=0), made.sum(axis=0), (~made & observed).sum(axis=0)]
        names = ["far", "square", "both", "made", "none"]
        yield pa.RecordBatch.from_arrays([pa.array(range(many), pa.int32()), *(pa.array(x, pa.float64()) for x in total)], ["k", *names])

    some = FC.with_reach(labelled, spec, [split], longest)
    sums = _in_order(some, spec, stats, longest).mapInArrow(errors, "k int, far double, square double, both double, made double, none double")
    added = sums.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("far", "square", "both", "made", "none")])
    labels = F.array(*[F.lit(label) for label, _, _ in fitted])
    return added.select(
        F.get(labels, F.col("k")).alias("candidate"), F.lit(fitted[0][1].name).alias("model"), X.safe_div(F.col("far"), F.col("both")).alias("valid_mae"),
        F.sqrt(X.safe_div(F.col("square"), F.col("both"))).alias("valid_rmse"), F.col("made").cast("long").alias("n"), F.col("none").cast("long").alias("n_without_forecast"),
    )


# --- tuning and final fits -------------------------------------------------------------------------


# The orders that are searched.
K_DAILY = (2, 3, 4, 6, 8)
K_WEEKLY = (1, 2, 3)
AR_ORDERS = (1, 2, 3)


def harmonic_grid(
    labelled: DataFrame,
    spec: PanelSpec,
    k_daily: Sequence[int] = K_DAILY,
    k_weekly: Sequence[int] = K_WEEKLY,
    ar: Sequence[int] = AR_ORDERS,
    fit_on: Sequence[str] = TRAIN,
) -> DataFrame:
    """Every candidate fitted in every area from one pass: ``(area, k_daily, k_weekly, ar, beta, phi, rss, n, k)``.

    The regressors of a candidate are some of the largest one's, so its products are a part of the largest one's products. All candidates
    are held to the rows that have as many predecessors as the highest order asks for, which makes their criteria comparable.
    """
    most = {spec.daily: max(k_daily), spec.weekly: max(k_weekly)}
    p_most = max(ar)
    width = 2 + 2 * sum(most.values())
    listed = pa.list_(pa.float64())

    def solve(level: np.ndarray, cross: np.ndarray, n: int) -> dict:
        out, square = [], cross.reshape(p_most + 1, width, p_most + 1, width)
        for d in k_daily:
            for w in k_weekly:
                mine = np.concatenate((np.arange(1 + 2 * d), 1 + 2 * most[spec.daily] + np.arange(2 * w), [width - 1]))
                beta, _, rss = harmonic_solve(level[np.ix_(mine, mine)], cross, 0)
                # the residuals are those of every order
                c = np.zeros(width)
                c[mine] = np.append(-beta, 1.0)
                e = residual_products(c, square, p_most)
                out += [(d, w, p, beta, *(ar_solve(e, p) if p else (np.zeros(0), rss))) for p in ar]
        names = ("k_daily", "k_weekly", "ar", "beta", "phi", "rss")
        kinds = (pa.int32(), pa.int32(), pa.int32(), listed, listed, pa.float64())
        columns = {c: pa.array(x, type=t) for c, x, t in zip(names, zip(*out, strict=True), kinds, strict=True)}
        return {**columns, "n": pa.array([n] * len(out), type=pa.int64())}

    schema = "area long, k_daily int, k_weekly int, ar int, beta array<double>, phi array<double>, rss double, n long"
    return harmonic_products(labelled, spec, most, p_most, fit_on, solve, schema).withColumn("k", F.size("beta") + F.size("phi") + 1)


def order_scores(labelled: DataFrame, fits: DataFrame, spec: PanelSpec, k_daily: int, k_weekly: int, orders: Sequence[int], split: str = "validation") -> DataFrame:
    """The error of each autoregressive order with the same harmonics, all orders from one pass over the split."""
    mine = fits.filter((F.col("k_daily") == k_daily) & (F.col("k_weekly") == k_weekly))
    model = mine.groupBy("area").agg(F.any_value("beta").alias("_beta"), *[F.max(F.when(F.col("ar") == p, F.col("phi"))).alias(f"_phi{p}") for p in orders])
    rows = FC.with_reach(labelled, spec, [split], max(orders)).join(model, "area", "left")
    terms = [F.lit(1.0), *X.fourier_columns("t_index", {spec.daily: k_daily, spec.weekly: k_weekly}).values()]
    fit = sum((F.get("_beta", F.lit(i)) * c for i, c in enumerate(terms)), F.lit(0.0))
    phis = [F.get(f"_phi{p}", F.lit(i)).alias(f"_phi{p}_{i}") for p in orders for i in range(p)]
    rows = rows.select("area", "t_index", "split", "value", fit.alias("_fit"), *phis).withColumn("_e", F.log1p("value") - F.col("_fit"))

    def build(w):
        past = [F.lag("_e", i + 1).over(w) for i in range(max(orders))]
        return {f"_p{p}": X.not_below_zero(F.expm1(F.col("_fit") + sum((F.col(f"_phi{p}_{i}") * past[i] for i in range(p)), F.lit(0.0)))) for p in orders}

    done = over_series(rows, build, before=max(orders)).filter(F.col("split") == split)
    each = done.select("value", F.inline(F.array(*[F.struct(F.lit(p).alias("ar"), F.col(f"_p{p}").alias("predicted")) for p in orders])))
    return each.groupBy("ar").agg(*_errors("value"))


def _errors(observed: str) -> list:
    gap = F.col("predicted") - F.col(observed)
    return [
        F.avg(F.abs(gap)).alias("valid_mae"), F.sqrt(F.avg(F.pow(gap, F.lit(2)))).alias("valid_rmse"), F.count("predicted").alias("n"),
        F.count_if(F.col("predicted").isNull() & F.col(observed).isNotNull()).alias("n_without_forecast"),
    ]


TUNED = "stage string, candidate string, model string, aicc double, valid_mae double, valid_rmse double, n long, n_without_forecast long, selected boolean"


def tune_harmonic(labelled: DataFrame, spec: PanelSpec, k_daily: Sequence[int] = K_DAILY, k_weekly: Sequence[int] = K_WEEKLY, ar: Sequence[int] = AR_ORDERS) -> tuple[Harmonic, DataFrame]:
    """Fourier orders by AICc summed over the areas, then the autoregressive order by validation error: the winner and one row per candidate.

    Ties go to the fewer parameters. One pass over train fits all candidates, one over validation scores all orders.
    """
    spark = labelled.sparkSession
    fits = durable(harmonic_grid(labelled, spec, k_daily, k_weekly, ar), "harmonic-grid")
    criteria = FC.information_criteria(fits.filter(F.col("ar") == max(ar))).groupBy("k_daily", "k_weekly").agg(F.sum("aicc").alias("aicc"))
    pairs = sorted(criteria.collect(), key=lambda r: (r["aicc"], r["k_daily"], r["k_weekly"]))  # one row per pair of orders
    d, w = pairs[0]["k_daily"], pairs[0]["k_weekly"]
    scores = sorted(order_scores(labelled, fits, spec, d, w, ar).collect(), key=lambda r: (r["valid_mae"], r["ar"]))
    name = Harmonic(spec).name
    rows = [("fourier_order", f"k_daily={r['k_daily']} k_weekly={r['k_weekly']}", name, r["aicc"], None, None, None, None, r is pairs[0]) for r in pairs]
    rows += [("ar_order", f"ar={r['ar']}", name, None, r["valid_mae"], r["valid_rmse"], r["n"], r["n_without_forecast"], r is scores[0]) for r in scores]
    return Harmonic(spec, d, w, scores[0]["ar"]), spark.createDataFrame(rows, TUNED)


def tune_stages(
    start: FC.Forecaster, stages: Sequence[tuple[str, Sequence[Mapping]]], labelled: DataFrame, spec: PanelSpec, grid: Callable[..., DataFrame] | None = None
) -> tuple[FC.Forecaster, DataFrame]:
    """One axis after the other, each from the winner of the one before: the last winner and one row per candidate.

    ``grid`` fits and scores the candidates of a stage; ``tune_grid``, if none is given.
    """
    spark, rows, current = labelled.sparkSession, [], start
    for stage, changes in stages:
        options = {", ".join(f"{k}={v}" for k, v in c.items()): dataclasses.replace(current, **c) for c in changes}
        scored = (grid or tune_grid)(list(options.items()), labelled, spec, stage).collect()  # one row per candidate, best first
        current = options[scored[0]["candidate"]]
        rows += [(stage, r["candidate"], r["model"], None, r["valid_mae"], r["valid_rmse"], r["n"], r["n_without_forecast"], r is scored[0]) for r in scored]
    return current, spark.createDataFrame(rows, TUNED)


def tune_windows(start: WindowRegression, stages: Sequence[tuple[str, Sequence[Mapping]]], labelled: DataFrame, spec: PanelSpec) -> tuple[WindowRegression, DataFrame]:
    """``tune_stages`` for the window model: one pass over train for all candidates, one over validation for each stage."""
    stats = _statistics(labelled)
    lengths = {start.length, *(c["length"] for _, changes in stages for c in changes if "length" in c)}
    products = window_products(labelled, spec, stats, sorted(lengths), start.fit_on)

    def grid(candidates: Sequence[tuple[str, WindowRegression]], labelled: DataFrame, spec: PanelSpec, stage: str) -> DataFrame:
        fitted = [(label, m, m.solve(labelled.sparkSession, products, stats)) for label, m in candidates]
        return window_scores(fitted, labelled, spec, stats).orderBy(F.asc_nulls_last("valid_mae"), "candidate")

    return tune_stages(start, stages, labelled, spec, grid)


def window_stages(spec: PanelSpec) -> list[tuple[str, list[dict]]]:
    """How much history a window holds, how strongly it is regularised, and whether the calendar helps."""
    lengths = sorted({max(1, spec.daily // 4), max(1, spec.daily // 2), spec.daily, 2 * spec.daily})
    return [
        ("sequence_length", [{"length": n} for n in lengths]),
        ("regularisation", [{"reg": r, "mix": m} for r in (0.0001, 0.001, 0.01) for m in (0.0, 0.5)]),
        ("calendar_ablation", [{"calendar": True}, {"calendar": False}]),
    ]


def tree_stages() -> list[tuple[str, list[dict]]]:
    """Depth and leaf size together, as they trade off."""
    return [("trees", [{"depth": d, "min_rows": m} for d in (3, 5) for m in (20, 100)])]


def tune_grid(
    candidates: Sequence[tuple[str, FC.Forecaster]], labelled: DataFrame, spec: PanelSpec, stage: str = "grid"
) -> DataFrame:
    """Every candidate fitted on train and scored on validation, one row each, best first.

    Scores are taken over all areas of ``labelled``; pass one area to tune on that area.
    """
    table = None
    for label, forecaster in candidates:
        rows = FC.walk_forward(forecaster, labelled, spec, "validation", forecaster.fit(labelled))
        score = rows.groupBy("model").agg(*_errors("observed"))
        score = score.select(F.lit(stage).alias("stage"), F.lit(label).alias("candidate"), "model", "valid_mae", "valid_rmse", "n", "n_without_forecast")
        table = score if table is None else table.unionByName(score)
    return table.orderBy(F.asc_nulls_last("valid_mae"), "candidate")


def best_candidate(table: DataFrame) -> str:
    """The label of the candidate with the lowest validation error, ties by label."""
    return table.orderBy(F.asc_nulls_last("valid_mae"), "candidate").first()["candidate"]


def log_rows(table: DataFrame, rationale: str) -> DataFrame:
    """One row of the experiment log for each candidate of a tuning stage."""
    return table.select(
        "model", "stage", F.col("candidate").alias("hyperparams_json"), "valid_mae", "valid_rmse", F.lit(rationale).alias("rationale_for_next_change")
    )


def settled(forecaster: FC.Forecaster, labelled: DataFrame) -> FC.Forecaster:
    """The forecaster for the final fit on train and validation.

    Where validation decided when to stop, the number of trees it arrived at is kept, as nothing is left to stop on.
    """
    changes: dict = {"fit_on": REFIT} if hasattr(forecaster, "fit_on") else {}
    if getattr(forecaster, "early_stop", False):
        changes |= {"early_stop": False, "trees": int(forecaster.fit(labelled).model.getNumTrees)}
    return dataclasses.replace(forecaster, **changes) if changes else forecaster


def final_scores(forecaster: FC.Forecaster, labelled: DataFrame, spec: PanelSpec, split: str = "test") -> DataFrame:
    """Refit on train and validation with settled parameters, then score a held-out split."""
    final = settled(forecaster, labelled)
    rows = FC.walk_forward(final, labelled, spec, split, final.fit(labelled))
    return M.metric_table(rows, M.mase_scale(labelled, spec), spec)


def final_predictions(
    forecasters: Sequence[FC.Forecaster], labelled: DataFrame, spec: PanelSpec, splits: tuple[str, ...] = ("test", "stress")
) -> DataFrame:
    """One table of forecasts of both baselines and every settled forecaster, for metrics, diagnostics and ensembles.

    A forecaster with seeds is listed once for each. The table is written, as many reports read it.
    """
    table = FC.baseline_predictions(labelled, spec, splits)
    for forecaster in forecasters:
        final = settled(forecaster, labelled)
        model = final.fit(labelled)
        for split in splits:
            table = table.unionByName(FC.walk_forward(final, labelled, spec, split, model))
    return durable(table, "predictions")
