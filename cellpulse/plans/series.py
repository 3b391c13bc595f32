"""Window plans for long series.

``partitionBy(area)`` alone would put a whole series on one task. Here the time axis is cut into
chunks of a fixed number of steps and each chunk also receives the few rows before and after it
which the frames reach (its halo). A window group is then at most ``chunk + before + after`` rows,
whatever the length of the series, and few long series still fill many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cellpulse.functions.exprs import idiv

CHUNK_STEPS = 8_192


def chunk_size(before: int, after: int, chunk: int | None = None) -> int:
    """Chunks stay at least eight halos long, so the halo copies add at most an eighth."""
    return chunk or max(CHUNK_STEPS, 8 * (before + after))


def with_halo(df: DataFrame, before: int = 0, after: int = 0, t: str = "t_index", chunk: int | None = None) -> DataFrame:
    """Add ``_chunk`` and ``_home``; rows near a border are repeated in the neighbouring chunk."""
    size = chunk_size(before, after, chunk)
    home = idiv(t, size)
    if not (before or after):
        return df.withColumn("_chunk", home).withColumn("_home", F.lit(True))
    first = idiv(F.greatest(F.col(t) - after, F.lit(0)), size)
    last = idiv(F.col(t) + before, size)
    out = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return out.withColumn("_home", F.col("_chunk") == home)


def over_series(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = ("area",),
    t: str = "t_index",
    chunk: int | None = None,
) -> DataFrame:
    """Add the columns ``build`` returns, computed over time within each series.

    ``build`` gets the ordered window of one chunk; its frames may reach at most ``before`` rows back
    and ``after`` rows ahead. All columns of one call share one shuffle and one sort.
    """
    parts = with_halo(df, before, after, t, chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(t)
    new = build(w)
    kept = [c for c in df.columns if c not in new]
    out = parts.select(*kept, "_home", *[c.alias(n) for n, c in new.items()])
    return out.filter("_home").drop("_home")


def running_total(df: DataFrame, value: str, name: str, keys: Sequence[str] = ("area",), t: str = "t_index", chunk: int | None = None) -> DataFrame:
    """Cumulative sum over the whole series: within chunks first, then shifted by chunk totals."""
    parts = df.withColumn("_chunk", idiv(t, chunk or CHUNK_STEPS))
    totals = parts.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn(name, F.sum(value).over(inside))
    return (
        local.join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col(name) + F.col("_base"))
        .drop("_chunk", "_base")
    )


def ordinal(df: DataFrame, t: str, name: str, keys: Sequence[str] = (), chunk: int = CHUNK_STEPS) -> DataFrame:
    """Exact 1-based position of each distinct integer ``t`` in order, without a single-task sort."""
    parts = df.withColumn("_chunk", idiv(t, chunk))
    sizes = parts.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(t)
    return (
        parts.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_rn") + F.col("_base"))
        .drop("_chunk", "_rn", "_base")
    )


BLOCK = 4_096


def whole_numbers(bounds: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """Every integer from ``low`` to ``high`` of each row of ``bounds``, spread over all tasks.

    One generator makes blocks, the blocks are shuffled by the row they come from and their number, and a
    second generator fills them. Neither one long row nor many short ones meet in a single task.
    """
    kept = [c for c in bounds.columns if c != name]
    blocks = bounds.select(*kept, F.explode(F.sequence(idiv(low, BLOCK), idiv(high, BLOCK))).alias("_block"))
    inside = F.sequence(F.greatest(F.col(low), F.col("_block") * BLOCK), F.least(F.col(high), (F.col("_block") + 1) * BLOCK - 1))
    return spread(blocks, *kept, "_block").select(*kept, F.explode(inside).alias(name))


PARTITION_ROWS = 250_000
"""Rows that one partition should hold where their number is known beforehand."""


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash-partition by ``keys`` and keep the full number of partitions, or more if ``rows`` are too many for it.

    Adaptive execution merges partitions by bytes; the steps after this one cost time per group or
    multiply their rows. A grouping on the same keys reuses this partitioning, so it adds no shuffle. With ``rows`` the size of a
    task stays the same however large the table is.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS)), *keys)
