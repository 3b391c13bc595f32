"""Time-series characterisation of every area at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators.quality import PanelError
from cellpulse.plans.series import CHUNK_STEPS, over_series, spread, with_halo
from cellpulse.settings import PanelSpec


def difference(panel: DataFrame, lag: int = 1, value: str = "value", name: str | None = None) -> DataFrame:
    """``v(t) - v(t - lag)``; NULL where there is no earlier value."""
    out = name or f"diff_{lag}"
    return over_series(panel, lambda w: {out: F.col(value) - F.lag(value, lag).over(w)}, before=lag)


def rolling_stats(panel: DataFrame, window: int, value: str = "value") -> DataFrame:
    """Trailing mean and population standard deviation over full windows only."""
    if window < 2:
        raise PanelError(f"window {window} is too short")

    def build(w):
        frame = w.rowsBetween(-(window - 1), 0)
        return {"roll_mean": F.avg(value).over(frame), "roll_std": F.stddev_pop(value).over(frame)}

    return over_series(panel, build, before=window - 1).filter(F.col("t_index") >= window - 1)


# --- autocorrelation -----------------------------------------------------------------------------


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def key_columns(keys: Sequence[str], group: tuple, n: int) -> dict:
    return {k: pa.array([v.as_py()] * n, type=v.type) for k, v in zip(keys, group)}


def lag_sums(t: np.ndarray, x: np.ndarray, own: np.ndarray, n_lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every lag over the own steps whose partner is known: sum of products, sum of both values, and number of pairs."""
    size = int(t[-1] - t[0]) + 1
    lags = min(n_lags, size - 1)
    full, known, home = np.zeros(lags + size), np.zeros(lags + size), np.zeros(size)
    seen = ~np.isnan(x)
    full[lags + t - t[0]] = np.where(seen, x, 0.0)
    known[lags + t - t[0]] = seen
    home[t - t[0]] = seen & own
    back = [np.lib.stride_tricks.sliding_window_view(v, lags + 1) for v in (full, known)]
    here = home * full[lags:]
    return tuple(v[::-1] for v in (here @ back[0], here @ back[1] + home @ back[0], home @ back[1]))


def _arrays(rows: pa.Table, name: str) -> list[np.ndarray]:
    """The arrays of a list column, one a row."""
    lists = rows.column(name).combine_chunks()
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _series_bounds(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each series of rows in the order of ``keys`` begins, and the end."""
    new = np.zeros(len(rows) + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        code = rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:-1] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def lag_products(
    panel: DataFrame, n_lags: int, keys: Sequence[str] = ("area",), value: str = "value", chunk: int | None = None
) -> DataFrame:
    """``sum over t of x(t) x(t - k)`` for k = 0..n_lags per series, x centred on the series mean.

    Exploding the lags and joining would multiply the panel by ``n_lags``. Here Spark cuts each series
    into chunks with a halo of ``n_lags`` rows, each chunk is reduced where it lies to sums about its own mean, and only those
    are shuffled, moved to the mean of the series and added. A panel that lies by its first key is not moved, and all series of
    that key share a group. ``n`` is the series length, ``n_rows`` counts NULLs too, ``lowest`` and ``highest`` are its range.
    """
    first, rest = keys[0], list(keys[1:])
    order = [*[(k, "ascending") for k in rest], ("t_index", "ascending")]
    parts = with_halo(panel.select(*keys, "t_index", F.col(value).cast("double").alias("x")), before=n_lags, chunk=chunk)
    types = dict(panel.dtypes)
    listed = pa.list_(pa.float64())
    scalars, lists = ("n_rows", "n", "lowest", "highest", "centre"), ("product", "both", "pairs")

    def sums(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        t, x, own = column(rows, "t_index"), column(rows, "x").astype(float), column(rows, "_home").astype(bool)
        bounds, at, out = _series_bounds(rows, rest), [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            mine = x[a:b][own[a:b]]
            if not len(mine):
                continue
            known = mine[~np.isnan(mine)]
            # the mean of equal values may be off by rounding
            centre = 0.0 if not len(known) else known[0] if known.min() == known.max() else known.mean()
            ends = (known.min(), known.max()) if len(known) else (None, None)
            at.append(a)
            out.append((len(mine), len(known), *ends, centre, *lag_sums(t[a:b], x[a:b] - centre, own[a:b], n_lags)))
        kinds = dict.fromkeys(scalars[:2], pa.int64()) | dict.fromkeys(scalars[2:], pa.float64()) | dict.fromkeys(lists, listed)
        made = zip(kinds.items(), list(zip(*out, strict=True)) or [()] * len(kinds), strict=True)
        names = {k: rows.column(k).take(pa.array(at, type=pa.int64())) for k in rest}
        return pa.table({**key_columns((first,), group, len(at)), **names, **{c: pa.array(list(v), type=kind) for (c, kind), v in made}})

    def added(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(k, "ascending") for k in rest]) if rest else rows
        bounds, out, at = _series_bounds(rows, rest), [], []
        number = {c: column(rows, c) for c in scalars}
        sums_of = [_arrays(rows, c) for c in lists]
        for a, b in zip(bounds[:-1], bounds[1:]):
            weight, centre = number["n"][a:b], number["centre"][a:b]
            n = int(weight.sum())
            away = (float((centre - centre[0]) @ weight) / n if n else 0.0) + centre[0] - centre
            total = np.zeros(max(len(sums_of[0][i]) for i in range(a, b)))
            for i, shift in zip(range(a, b), away):
                product, both, pairs = (v[i] for v in sums_of)
                # a short chunk has fewer lags
                total[: len(product)] += product - shift * both + shift * shift * pairs
            low, high = (float(end.reduce(number[c][a:b].astype(float))) for end, c in ((np.fmin, "lowest"), (np.fmax, "highest")))
            at += [a] * len(total)
            out.append((total, n, int(number["n_rows"][a:b].sum()), low, high))
        sizes = [len(o[0]) for o in out]
        table = {**key_columns((first,), group, len(at)), **{k: rows.column(k).take(pa.array(at, type=pa.int64())) for k in rest}}
        table["lag"] = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
        table["product"] = np.concatenate([o[0] for o in out])
        table["n"] = np.repeat([o[1] for o in out], sizes)
        table["c0"] = np.repeat([o[0][0] for o in out], sizes)
        table["n_rows"] = np.repeat([o[2] for o in out], sizes)
        for i, name in ((3, "lowest"), (4, "highest")):
            table[name] = pa.array(np.repeat(np.array([o[i] for o in out], dtype=float), sizes), from_pandas=True)
        return pa.table(table)

    named = ", ".join(f"{k} {types[k]}" for k in keys)
    arrays = ", ".join(f"{c} array<double>" for c in lists)
    partial = parts.groupBy(first, "_chunk").applyInArrow(sums, f"{named}, n_rows long, n long, lowest double, highest double, centre double, {arrays}")
    found = spread(partial, first).groupBy(first).applyInArrow(added, f"{named}, lag int, product double, n long, c0 double, n_rows long, lowest double, highest double")
    return found.select(*keys, "lag", "product", "n", "c0", "n_rows", "lowest", "highest")


def acf(
    panel: DataFrame, n_lags: int, keys: Sequence[str] = ("area",), value: str = "value", z: float = 1.959963984540054
) -> DataFrame:
    """Biased autocorrelation with Bartlett bands, one row per series and lag. NULL for a constant series."""
    rows = lag_products(panel, n_lags, keys, value).withColumn("acf", X.safe_div(F.col("product"), F.col("c0")))
    earlier = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    square = F.when(F.col("lag") > 0, F.col("acf") * F.col("acf")).otherwise(F.lit(0.0))
    spread_ = F.sqrt((1 + 2 * F.coalesce(F.sum(square).over(earlier), F.lit(0.0))) / F.col("n"))
    band = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(F.lit(z) * spread_)
    return rows.withColumn("_band", band).select(
        *keys, "lag", "acf", (F.col("acf") - F.col("_band")).alias("lower"), (F.col("acf") + F.col("_band")).alias("upper"), "n"
    )


def acf_peaks(acf_rows: DataFrame, floor: float = 0.2, top: int = 10, keys: Sequence[str] = ("area",)) -> DataFrame:
    """Strict local maxima above ``floor`` from lag 2 on, the ``top`` highest per series."""
    w = Window.partitionBy(*keys).orderBy("lag")
    sides = acf_rows.select(
        *keys, "lag", "acf", F.lag("acf").over(w).alias("_left"), F.lead("acf").over(w).alias("_right")
    )
    peaks = sides.filter(
        (F.col("lag") >= 2) & (F.col("acf") > F.col("_left")) & (F.col("acf") > F.col("_right")) & (F.col("acf") > floor)
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("acf"), "lag")
    return (
        peaks.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top).drop("_left", "_right")
    )


PACF_LAGS = 400


def pacf(panel: DataFrame, spec: PanelSpec, n_lags: int, value: str = "value") -> DataFrame:
    """Yule-Walker partial autocorrelation to min(n_lags, n/2 - 1); more than ``PACF_LAGS`` lags are refused.

    Spark reduces each series to its autocorrelations, at most ``PACF_LAGS`` + 1 numbers, and the recursion folds over them where they
    lie. NULL from the order on that leaves no error to explain; a constant series has no rows.
    """
    if n_lags > PACF_LAGS:
        raise ValueError(f"at most {PACF_LAGS} partial autocorrelations, {n_lags} asked for")
    limit = min(n_lags, max(1, spec.n_steps // 2 - 1))
    rho = acf(panel, limit, value=value).filter("acf is not null").groupBy("area").agg(
        F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_r"), F.max("n").alias("_n")
    )
    folded = rho.select("area", "_n", levinson(F.col("_r.acf")).alias("_p")).select("area", "_n", F.posexplode("_p").alias("lag", "pacf"))
    half = F.when(F.col("lag") == 0, 0.0).otherwise(F.lit(1.959963984540054) / F.sqrt("_n"))
    return folded.select("area", "lag", "pacf", (F.col("pacf") - half).alias("lower"), (F.col("pacf") + half).alias("upper"))


def levinson(rho: Column) -> Column:
    """Partial autocorrelations from an array of autocorrelations, lag 0 first, by the Levinson-Durbin recursion."""
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), F.get(rho, F.lit(0)).alias("error"), F.array(F.lit(1.0)).alias("out"))

    def step(s: Column, k: Column) -> Column:
        known = F.zip_with(s["phi"], F.reverse(F.slice(rho, 2, k - 1)), lambda a, b: a * b)
        rest = F.get(rho, k) - F.aggregate(known, F.lit(0.0), lambda total, x: total + x)
        # a one-element array gives the reflection a name, so it is worked out once
        reflection = F.array(F.when(s["error"] > 0, rest / F.nullif(s["error"], F.lit(0.0))))
        return F.get(F.transform(reflection, lambda r: F.struct(
            F.array_append(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - r * b), r).alias("phi"),
            (s["error"] * (1 - r * r)).alias("error"),
            F.array_append(s["out"], r).alias("out"),
        )), F.lit(0))

    # a series of one lag has nothing to fold over
    orders = F.when(F.size(rho) > 1, F.sequence(F.lit(1), F.size(rho) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(orders, start, step, lambda s: s["out"])


# --- spectrum ------------------------------------------------------------------------------------


def _stride(n: int, limit: int) -> int:
    """The least divisor of ``n`` that leaves sub-series of at most ``limit`` steps."""
    return next(m for m in range(1, n + 1) if n % m == 0 and n // m <= limit)


def periodogram(panel: DataFrame, spec: PanelSpec, value: str = "value", chunk: int | None = None) -> DataFrame:
    """One-sided density periodogram of every series: ``(area, k, frequency, power)``, k >= 1.

    The mean of the known values is taken off first, so a NULL counts as an average value. A series longer than a chunk is
    transformed in two steps: every m-th value makes a sub-series with a transform of its own, and then, for each of its frequencies,
    the m results are transformed across. Both steps hand on as many rows as the series is long. A
    length without a suitable divisor is one group in the second step.
    """
    n, fs = spec.n_steps, spec.samples_per_hour
    half, m = n // 2, _stride(spec.n_steps, chunk or CHUNK_STEPS)
    size = n // m
    block = max(1, (chunk or CHUNK_STEPS) // m)
    means = panel.groupBy("area").agg(F.avg(value).alias("_mean"))
    centred = panel.join(means, "area").select(
        "area", (F.col("t_index") % m).cast("int").alias("r"), X.idiv("t_index", m).alias("s"), (F.col(value) - F.col("_mean")).alias("x")
    )

    def along(group: tuple, rows: pa.Table) -> pa.Table:
        at, x = np.zeros(size), column(rows, "x")
        at[column(rows, "s").astype(np.int64)] = np.nan_to_num(x)
        k, r = np.arange(size), int(group[1].as_py())
        f = np.fft.fft(at) * np.exp(-2j * np.pi * ((k * r) % n) / n)
        return pa.table({**key_columns(("area", "r"), group, size), "k": k.astype(np.int32), "re": f.real, "im": f.imag})

    def across(group: tuple, rows: pa.Table) -> pa.Table:
        first = int(group[1].as_py()) * block
        many = min(block, size - first)
        at = np.zeros((many, m), complex)
        at[column(rows, "k").astype(np.int64) - first, column(rows, "r").astype(np.int64)] = column(rows, "re") + 1j * column(rows, "im")
        f = np.fft.fft(at, axis=1)
        k = np.arange(first, first + many)[:, None] + size * np.arange(m)[None, :]
        keep = (k >= 1) & (k <= half)
        return pa.table({**key_columns(("area",), group[:1], int(keep.sum())), "k": k[keep].astype(np.int32), "square": np.abs(f[keep]) ** 2})

    steps = spread(centred, "area", "r").groupBy("area", "r").applyInArrow(along, "area long, r int, k int, re double, im double")
    if m == 1:
        squares = steps.filter((F.col("k") >= 1) & (F.col("k") <= half))
        squares = squares.select("area", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("square"))
    else:
        blocks = steps.withColumn("b", X.idiv("k", block).cast("int"))
        squares = spread(blocks, "area", "b").groupBy("area", "b").applyInArrow(across, "area long, k int, square double")
    doubled = F.when((F.col("k") * 2 == n), F.lit(1.0)).otherwise(F.lit(2.0))
    return squares.select(
        "area",
        "k",
        (F.col("k") * F.lit(fs / n)).alias("frequency_per_hour"),
        (doubled * F.col("square") / F.lit(fs * n)).alias("power"),
    )


def periodogram_peaks(panel: DataFrame, spec: PanelSpec, top: int = 6, value: str = "value") -> DataFrame:
    """The strongest positive frequencies per series with their period in hours."""
    order = Window.partitionBy("area").orderBy(F.desc("power"), "k")
    return (
        periodogram(panel, spec, value)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= top)
        .withColumn("period_hours", 1 / F.col("frequency_per_hour"))
    )


# --- decomposition -------------------------------------------------------------------------------


def seasonal_decompose(panel: DataFrame, spec: PanelSpec, periods: Sequence[int], value: str = "value") -> DataFrame:
    """Additive trend, one seasonal component per period, and residual; they sum to the observation.

    Trend: centred moving average over the longest period (shorter at the two ends of the series).
    Seasonals: means of what is left per position in the cycle, shortest period first, each centred on
    zero. This is a moving-average decomposition, not a LOESS one, so component values differ from it.
    """
    ordered = sorted(periods)
    longest = ordered[-1]
    if spec.n_steps < 2 * longest:
        raise PanelError(f"{spec.n_steps} steps are less than two cycles of {longest}")
    reach = longest // 2

    parts = with_halo(panel, reach + 1, reach)
    w = Window.partitionBy("area", "_chunk").orderBy("t_index")
    # prefix sums make a long frame cheap: two look-ups instead of ``longest`` additions per row
    prefix = w.rowsBetween(Window.unboundedPreceding, 0)
    prefixed = parts.withColumn("_sum", F.sum(value).over(prefix)).withColumn("_cnt", F.count(value).over(prefix))
    edge = F.struct(F.col("_sum").alias("s"), F.col("_cnt").alias("c"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # only the end of the series has no row ``reach`` steps ahead; there the frame stops at its last row
    ahead = F.coalesce(F.lead(edge, reach).over(w), F.last(edge).over(whole))
    behind = F.lag(edge, reach + 1).over(w)
    total = ahead["s"] - F.coalesce(behind["s"], F.lit(0.0))
    count = ahead["c"] - F.coalesce(behind["c"], F.lit(0))
    out = (
        prefixed.withColumn("trend", X.safe_div(total, count.cast("double")))
        .filter("_home")
        .drop("_sum", "_cnt", "_chunk", "_home")
        .withColumn("residual", F.col(value) - F.col("trend"))
    )
    if any(long % short for short, long in zip(ordered, ordered[1:])):
        for period in ordered:
            out = _take_cycle(out, period)
        return out
    return _take_nested_cycles(out, ordered)


def _take_cycle(rows: DataFrame, period: int) -> DataFrame:
    """Move the per-phase mean of ``residual`` into ``seasonal_<period>``, centred on zero."""
    phase = F.pmod(F.col("t_index"), F.lit(period))
    means = rows.groupBy("area", phase.alias("_phase")).agg(F.avg("residual").alias("_m"))
    level = means.groupBy("area").agg(F.avg("_m").alias("_level"))
    shape = means.join(level, "area").select("area", "_phase", (F.col("_m") - F.col("_level")).alias(f"seasonal_{period}"))
    return (
        rows.withColumn("_phase", phase)
        .join(shape, ["area", "_phase"])
        .withColumn("residual", F.col("residual") - F.col(f"seasonal_{period}"))
        .drop("_phase")
    )


def _take_nested_cycles(rows: DataFrame, periods: Sequence[int]) -> DataFrame:
    """The same for periods that divide each other, from one aggregate by phase of the longest.

    A phase of the longest period fixes the phase of every shorter one, so all seasonal shapes follow
    from a table of ``longest`` rows per area, and the panel is read once for it instead of once per
    period.
    """
    longest = periods[-1]
    phase = F.pmod(F.col("t_index"), F.lit(longest))
    shape = rows.groupBy("area", phase.alias("_phase")).agg(F.sum("residual").alias("_s"), F.count("residual").alias("_n"))
    for period in periods:
        same = Window.partitionBy("area", F.pmod(F.col("_phase"), F.lit(period)))
        mean = X.safe_div(F.sum("_s").over(same), F.sum("_n").over(same).cast("double"))
        shape = shape.withColumn("_m", mean)
        level = F.avg("_m").over(Window.partitionBy("area"))
        name = f"seasonal_{period}"
        shape = shape.withColumn(name, F.col("_m") - level).withColumn("_s", F.col("_s") - F.col(name) * F.col("_n"))
    names = [f"seasonal_{p}" for p in periods]
    joined = rows.withColumn("_phase", phase).join(shape.select("area", "_phase", *names), ["area", "_phase"])
    return joined.withColumn("residual", F.col("residual") - sum((F.col(n) for n in names), F.lit(0.0))).drop("_phase")


def component_strength(components: DataFrame, periods: Sequence[int], value: str = "value") -> DataFrame:
    """Variance share of each component and strength max(0, 1 - var(r) / var(c + r)), long form."""
    names = ["trend", *[f"seasonal_{p}" for p in sorted(periods)]]
    aggs = [F.var_pop(value).alias("_obs"), F.var_pop("residual").alias("_res"), F.stddev_pop(value).alias("observed_std"), F.stddev_pop("residual").alias("residual_std")]
    for n in names:
        aggs += [F.var_pop(n).alias(f"_v_{n}"), F.var_pop(F.col(n) + F.col("residual")).alias(f"_c_{n}")]
    wide = components.groupBy("area").agg(*aggs)
    entries = [
        F.struct(
            F.lit(n).alias("component"),
            F.coalesce(X.safe_div(F.col(f"_v_{n}"), F.col("_obs")), F.lit(0.0)).alias("variance_share"),
            F.coalesce(
                F.greatest(F.lit(0.0), 1 - X.safe_div(F.col("_res"), F.when(F.col(f"_c_{n}") > 0, F.col(f"_c_{n}")))), F.lit(0.0)
            ).alias("strength"),
        )
        for n in names
    ]
    entries.append(
        F.struct(
            F.lit("residual").alias("component"),
            F.coalesce(X.safe_div(F.col("_res"), F.col("_obs")), F.lit(0.0)).alias("variance_share"),
            F.lit(None).cast("double").alias("strength"),
        )
    )
    return wide.select("area", "observed_std", "residual_std", F.inline(F.array(*entries)))
