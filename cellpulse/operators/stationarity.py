"""Unit-root and level-stationarity tests for every area at once.

Spark reduces each series to a handful of sums; only those reach numpy. The published response
surfaces and critical values below are fixed numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators.series import column, difference, key_columns
from cellpulse.operators.panel import PLACED_STEPS
from cellpulse.plans.series import over_series, running_total, spread, with_halo
from cellpulse.settings import PanelSpec

# KPSS level test, Kwiatkowski et al. (1992), table 1.
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))

# MacKinnon (1994) p-value surface for the one-variable test with a constant.
MACKINNON_MAX = 2.74
MACKINNON_MIN = -18.83
MACKINNON_STAR = -1.61
MACKINNON_SMALL = (2.1659, 1.4412, 0.038269)
MACKINNON_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def kpss_pvalue(stat: Column) -> Column:
    """Linear interpolation in the table, clamped to [0.01, 0.1]."""
    out = F.when(stat <= KPSS_CRITICAL[0][0], F.lit(0.10))
    for (s0, p0), (s1, p1) in zip(KPSS_CRITICAL, KPSS_CRITICAL[1:]):
        out = out.when(stat <= s1, F.lit(p0) + (stat - F.lit(s0)) * F.lit((p1 - p0) / (s1 - s0)))
    return F.when(stat.isNotNull(), out.otherwise(F.lit(0.01)))


def kpss(panel: DataFrame, spec: PanelSpec, value: str = "value") -> DataFrame:
    """Level KPSS with the Hobijn-Franses-Ooms automatic bandwidth; NULL for a constant series.

    The Bartlett-weighted long-run variance with bandwidth l equals the sum of squared sums over all
    windows of l + 1 residuals, divided by n (l + 1). Window sums are differences of the running sums
    the statistic needs anyway, so any bandwidth costs two look-ups a step instead of l lag products. The series
    must have no inner gaps. Up to ``PLACED_STEPS`` an area lies whole in one partition and is reduced to its sums there,
    so nothing is joined or moved; longer series are joined in chunks.
    """
    clean = panel.filter(F.col(value).isNotNull()).select("area", "t_index", F.col(value).cast("double").alias("v"))
    totals = _kpss_placed(clean) if spec.n_steps <= PLACED_STEPS else _kpss_joined(clean, spec)
    return totals.select("area", F.col("n").alias("n_obs"), *_kpss_columns())


def _kpss_columns() -> list[Column]:
    """Bandwidth, statistic and p-value from the sums ``n``, ``l``, ``eta`` and ``w``."""
    n = F.col("n").cast("double")
    variance = F.col("w") / (n * (F.col("l") + 1))
    stat = X.safe_div(F.col("eta") / (n * n), F.when(variance > 0, variance))
    return [F.col("l").cast("int").alias("kpss_lags"), stat.alias("kpss_stat"), kpss_pvalue(stat).alias("kpss_pvalue")]


def kpss_sums(v: np.ndarray) -> tuple[int, float, float]:
    """Bandwidth, squared running sums, and squared window sums of the residuals of one series."""
    n = len(v)
    if v.min() == v.max():
        return n - 1, 0.0, 0.0
    e = v - v.mean()
    cover = min(int(math.floor(n ** (2.0 / 9.0))), n - 1)
    c = [float(e[k:] @ e[: n - k]) for k in range(cover + 1)]
    s0 = c[0] / n + sum(x / (n / 2) for x in c[1:])
    s1 = sum(k * x / (n / 2) for k, x in enumerate(c))
    s = np.cumsum(e)
    ratio = s1 / s0 if s0 else math.inf
    wide = 1.1447 * (ratio * ratio) ** (1.0 / 3.0) * n ** (1.0 / 3.0)
    width = 0 if math.isnan(wide) else int(min(wide, n - 1))
    inside = s.copy()
    inside[width + 1 :] -= s[: n - width - 1]
    tail = s[max(0, n - width - 1) : n - 1]
    return width, float(s @ s), float(inside @ inside + tail @ tail)


def _kpss_placed(clean: DataFrame) -> DataFrame:
    """``(area, n, l, eta, w)`` from whole series."""

    def sums(group: tuple, rows: pa.Table) -> pa.Table:
        width, eta, w = kpss_sums(column(rows.sort_by("t_index"), "v"))
        made = {"n": pa.array([len(rows)], type=pa.int64()), "l": pa.array([width], type=pa.int64()), "eta": pa.array([eta]), "w": pa.array([w])}
        return pa.table({**key_columns(("area",), group, 1), **made})

    return clean.groupBy("area").applyInArrow(sums, "area long, n long, l long, eta double, w double")


def _kpss_joined(clean: DataFrame, spec: PanelSpec) -> DataFrame:
    """The same sums of longer series, by windows over chunks and joins; the panel's side of a join is never sent to all tasks."""
    stats = clean.groupBy("area").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.min("t_index").alias("t_first"))
    resid = clean.hint("merge").join(stats, "area").select(
        "area", "n", (F.col("t_index") - F.col("t_first")).alias("t_index"), (F.col("v") - F.col("m")).alias("e")
    )

    # automatic bandwidth from the first floor(n ** (2/9)) autocovariances: seven for 8,928 steps
    cover = int(spec.n_steps ** (2.0 / 9.0))
    lagged = over_series(
        resid, lambda w: {f"p{k}": F.col("e") * F.lag("e", k).over(w) for k in range(1, cover + 1)}, before=cover
    )
    used = F.floor(F.pow(F.col("n").cast("double"), F.lit(2.0 / 9.0)))
    n = F.col("n").cast("double")
    sums = lagged.groupBy("area", "n").agg(
        F.sum(F.col("e") * F.col("e")).alias("c0"), *[F.sum(f"p{k}").alias(f"c{k}") for k in range(1, cover + 1)]
    )
    s0, s1 = F.col("c0") / n, F.lit(0.0)
    for k in range(1, cover + 1):
        term = F.when(used >= k, F.col(f"c{k}") / (n / 2)).otherwise(0.0)
        s0, s1 = s0 + term, s1 + k * term
    ratio = X.safe_div(s1, s0)
    bandwidth = F.floor(F.lit(1.1447) * F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0)))
    chosen = sums.select("area", F.least(bandwidth, F.col("n") - 1).cast("long").alias("l"))

    running = running_total(resid, "e", "s").select("area", "n", "t_index", "s").hint("merge").join(chosen, "area")
    earlier = running.select("area", (F.col("t_index") + F.col("l") + 1).alias("t_index"), F.col("s").alias("s_before"))
    windows = running.hint("merge").join(earlier, ["area", "t_index"], "left")
    inside = F.col("s") - F.coalesce("s_before", F.lit(0.0))
    tail = F.when(F.col("t_index").between(F.col("n") - F.col("l") - 1, F.col("n") - 2), F.col("s") * F.col("s")).otherwise(0.0)
    return windows.groupBy("area", "n", "l").agg(
        F.sum(F.col("s") * F.col("s")).alias("eta"), F.sum(inside * inside + tail).alias("w")
    )


def adf_max_lag(n: int) -> int:
    return max(0, min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2))


ADF = "adf_stat double, adf_pvalue double, adf_lags int, adf_nobs long"


def adf(panel: DataFrame, spec: PanelSpec, value: str = "value", max_lag: int | None = None, chunk: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag order by AIC.

    One Gram matrix of (dy, y(t-1), lagged dy, 1) per area carries every nested lag order. Up to ``PLACED_STEPS`` it is made and
    solved where the area lies; of longer series, or with ``chunk``, chunks
    build partial Gram matrices in parallel; the solve sees a (p + 3) square matrix per area. The highest order
    that is tried follows from the number of values the area has, unless ``max_lag`` is given.
    """
    p = adf_max_lag(spec.n_steps) if max_lag is None else max_lag
    clean = panel.filter(F.col(value).isNotNull()).select("area", "t_index", F.col(value).cast("double").alias("v"))

    def tested(group: tuple, found: tuple) -> pa.Table:
        columns = {n: pa.array([x], type=t) for (n, t), x in zip(ADF_TYPES.items(), found, strict=True)}
        return pa.table({**key_columns(("area",), group, 1), **columns})

    def whole(group: tuple, rows: pa.Table) -> pa.Table:
        return tested(group, adf_of(column(rows.sort_by("t_index"), "v"), p, max_lag is not None))

    if chunk is None and spec.n_steps <= PLACED_STEPS:
        return clean.groupBy("area").applyInArrow(whole, f"area long, {ADF}")

    def gram(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("t_index")
        g, n, length, heads = adf_gram(column(rows, "v"), column(rows, "_home").astype(bool), p)
        return pa.table(
            {
                **key_columns(("area",), group, 1),
                "gram": pa.array([g.ravel()], type=pa.list_(pa.float64())),
                "rows": pa.array([n], type=pa.int64()),
                "length": pa.array([length], type=pa.int64()),
                "heads": pa.array([heads.ravel()], type=pa.list_(pa.float64())),
            }
        )

    def solve(group: tuple, rows: pa.Table) -> pa.Table:
        width = p + 3
        g = np.sum(np.array(rows.column("gram").to_pylist(), dtype=float), axis=0).reshape(width, width)
        heads = np.array([v for part in rows.column("heads").to_pylist() for v in part], dtype=float).reshape(-1, 3 + p)
        n, length = int(column(rows, "rows").sum()), int(column(rows, "length").sum())
        return tested(group, adf_solved(g, n, length, heads, p, max_lag is not None))

    parts = spread(with_halo(clean, before=p + 1, chunk=chunk), "area", "_chunk")
    partial = parts.groupBy("area", "_chunk").applyInArrow(gram, "area long, gram array<double>, rows long, length long, heads array<double>")
    return spread(partial, "area").groupBy("area").applyInArrow(solve, f"area long, {ADF}")


ADF_TYPES = {"adf_stat": pa.float64(), "adf_pvalue": pa.float64(), "adf_lags": pa.int32(), "adf_nobs": pa.int64()}


def adf_gram(y: np.ndarray, own: np.ndarray, p: int) -> tuple[np.ndarray, int, int, np.ndarray]:
    """The Gram matrix of the own rows with a whole history, their number, that of all own rows, and the rows that only lower orders can use."""
    dy = np.diff(y)  # dy[i] = y[i + 1] - y[i]
    at = np.flatnonzero(own)
    # fewer than p + 1 rows before the first own row: the series starts in this chunk
    full = at[at >= p + 1]
    z = np.column_stack([dy[full - 1], y[full - 1], *[dy[full - 1 - k] for k in range(1, p + 1)], np.ones(len(full))])
    # rows that only lower lag orders can use: position, dy, level, lagged dy as far as they exist
    heads = []
    for i in at[(at >= 1) & (at < p + 1)]:
        lags = [dy[i - 1 - k] if i - 1 - k >= 0 else 0.0 for k in range(1, p + 1)]
        heads += [float(i), dy[i - 1], y[i - 1], *lags]
    return z.T @ z, len(full), len(at), np.array(heads, dtype=float).reshape(-1, 3 + p)


def adf_solved(g: np.ndarray, n: int, length: int, heads: np.ndarray, p: int, fixed: bool) -> tuple[float, float, int, int]:
    """Statistic, p-value, lag order and rows used; unless ``fixed``, the highest order follows from the length."""
    own = p if fixed else min(p, adf_max_lag(length))
    stat, lags, used = adf_from_gram(*lower_order(g, n, heads, p, own), own)
    return stat, mackinnon_p(stat), lags, used


def adf_of(y: np.ndarray, p: int, fixed: bool = False) -> tuple[float, float, int, int]:
    """The test of one whole series."""
    return adf_solved(*adf_gram(y, np.ones(len(y), bool), p), p, fixed)


def _fit(g: np.ndarray, index: Sequence[int]):
    """Least squares of column 0 on ``index`` from a Gram matrix: coefficients, RSS, inverse."""
    a = g[np.ix_(index, index)]
    b = g[index, 0]
    try:
        inverse = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return None
    beta = inverse @ b
    return beta, float(g[0, 0] - b @ beta), inverse


def lower_order(g: np.ndarray, n: int, heads: np.ndarray, p: int, own: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The Gram matrix, row count and head rows as if the highest order had been ``own`` from the start."""
    kept = [*range(2 + own), p + 2]
    heads = heads[:, : 3 + own]
    g, joining = g[np.ix_(kept, kept)].copy(), heads[:, 0] >= own + 1
    for row in heads[joining]:
        z = np.concatenate([row[1:], [1.0]])
        g += np.outer(z, z)
    return g, n + int(joining.sum()), heads[~joining]


def adf_from_gram(g: np.ndarray, n: int, heads: np.ndarray, p: int) -> tuple[float, int, int]:
    """Choose the lag order by AIC on the common sample, then test on the order's own sample."""
    const = p + 2
    best, best_aic = 0, math.inf
    for lags in range(p + 1):
        index = [1, *range(2, 2 + lags), const]
        fitted = _fit(g, index)
        if fitted is None or fitted[1] <= 0 or n <= len(index):
            continue
        aic = n * (math.log(2 * math.pi) + math.log(fitted[1] / n) + 1) + 2 * len(index)
        if aic < best_aic:
            best, best_aic = lags, aic
    # with fewer lags the first rows of the series become usable again
    extra = heads[heads[:, 0] >= best + 1] if len(heads) else heads
    total = g.copy()
    for row in extra:
        z = np.concatenate([row[1:3], row[3 : 3 + p], [1.0]])
        total += np.outer(z, z)
    used = n + len(extra)
    index = [1, *range(2, 2 + best), const]
    fitted = _fit(total, index)
    if fitted is None or used <= len(index):
        return math.nan, best, used
    beta, rss, inverse = fitted
    variance = rss / (used - len(index)) * inverse[0, 0]
    return (float(beta[0] / math.sqrt(variance)) if variance > 0 else math.nan), best, used


def mackinnon_p(stat: float) -> float:
    if math.isnan(stat):
        return math.nan
    if stat > MACKINNON_MAX:
        return 1.0
    if stat < MACKINNON_MIN:
        return 0.0
    terms = MACKINNON_SMALL if stat <= MACKINNON_STAR else MACKINNON_LARGE
    z = sum(c * stat**i for i, c in enumerate(terms))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


# The four readings of the two tests taken together.
BOTH_STATIONARY = "stationary (both agree)"
BOTH_NOT = "non-stationary (both agree)"
BOTH_REJECT = "conflicting: difference-stationary or heteroscedastic"
NEITHER_REJECTS = "conflicting: inconclusive, likely near-unit-root"


def verdict(adf_p: Column, kpss_p: Column, alpha: float) -> Column:
    """The first test assumes a unit root, the second stationarity; NULL where either is undefined."""
    unit_root_out, level_out = adf_p < alpha, kpss_p < alpha
    undefined = adf_p.isNull() | F.isnan(adf_p) | kpss_p.isNull()
    return (
        F.when(undefined, F.lit(None).cast("string"))
        .when(unit_root_out, F.when(level_out, BOTH_REJECT).otherwise(BOTH_STATIONARY))
        .otherwise(F.when(level_out, BOTH_NOT).otherwise(NEITHER_REJECTS))
    )


def stationarity_table(panel: DataFrame, spec: PanelSpec, seasonal: int, alpha: float = 0.05) -> DataFrame:
    """Both tests on the raw series, its first difference and its seasonal difference.

    Up to ``PLACED_STEPS`` an area makes its three forms and all tests where it lies, from one pass over the panel.
    """
    base = panel.select("area", "t_index", F.col("value").cast("double").alias("value"))
    lags = {"raw": 0, "first difference": 1, f"seasonal difference (lag {seasonal})": seasonal}
    both = _placed_tests(base, spec, lags) if spec.n_steps <= PLACED_STEPS else _joined_tests(base, spec, lags)
    return both.select(
        "area",
        "transform",
        "n_obs",
        "adf_stat",
        "adf_pvalue",
        "adf_lags",
        (F.col("adf_pvalue") < alpha).alias("adf_rejects_unit_root"),
        "kpss_stat",
        "kpss_pvalue",
        "kpss_lags",
        (F.col("kpss_pvalue") < alpha).alias("kpss_rejects_stationarity"),
        verdict(F.col("adf_pvalue"), F.col("kpss_pvalue"), alpha).alias("verdict"),
    )


def _placed_tests(base: DataFrame, spec: PanelSpec, lags: dict[str, int]) -> DataFrame:
    p = adf_max_lag(spec.n_steps)

    def tests(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("t_index")
        v, known, out = column(rows, "value"), rows.column("value").is_valid().to_numpy(), []
        for label, lag in lags.items():
            made = known if lag == 0 else known[lag:] & known[:-lag]
            form = (v if lag == 0 else v[lag:] - v[:-lag])[made]
            if len(form):
                out.append((label, len(form), *kpss_sums(form), *adf_of(form, p)))
        found = list(zip(*out, strict=True)) or [()] * (len(types) - 1)
        columns = {c: pa.array(x, type=t) for (c, t), x in zip(list(types.items())[1:], found, strict=True)}
        return pa.table({**key_columns(("area",), group, len(out)), **columns})

    kinds = {"transform": pa.string(), "n": pa.int64(), "l": pa.int64(), "eta": pa.float64(), "w": pa.float64(), **ADF_TYPES}
    types = {"area": pa.int64(), **kinds}
    schema = f"area long, transform string, n long, l long, eta double, w double, {ADF}"
    return base.groupBy("area").applyInArrow(tests, schema).select("area", "transform", F.col("n").alias("n_obs"), *ADF_TYPES, *_kpss_columns())


def _joined_tests(base: DataFrame, spec: PanelSpec, lags: dict[str, int]) -> DataFrame:
    out = None
    for label, lag in lags.items():
        form = difference(base, lag, name="d").select("area", "t_index", F.col("d").alias("value")) if lag else base
        both = adf(form, spec).join(kpss(form, spec), "area").withColumn("transform", F.lit(label))
        out = both if out is None else out.unionByName(both)
    return out
