"""Sinks: parquet panels and tables, CSV / JSON result tables, the append-only experiment log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators.quality import PanelError, demand_empty
from cellpulse.plans.storage import durable

# Columns of the experiment log.
LOG_COLUMNS = (
    "run_id",
    "timestamp",
    "model",
    "area",
    "stage",
    "seed",
    "hyperparams_json",
    "feature_set",
    "train_mae",
    "valid_mae",
    "valid_rmse",
    "valid_mase",
    "train_wall_s",
    "n_params",
    "git_sha",
    "rationale_for_next_change",
)
LOG_NUMBERS = {"area": "long", "seed": "long", "n_params": "long"} | dict.fromkeys(
    ("train_mae", "valid_mae", "valid_rmse", "valid_mase", "train_wall_s"), "double"
)
"""Types of the columns that are not text."""


def sink_panel(panel: DataFrame, path: str, files_per_date: int = 1) -> None:
    """zstd parquet by local date; only the dates present in ``panel`` are replaced.

    Rows of a date are spread over ``files_per_date`` ranges of areas, and sorted by area inside each
    file, so a reader that wants a few areas skips most row groups.
    """
    dated = panel.withColumn("date", X.local_day("local")).withColumn("_part", F.pmod(F.xxhash64("area"), F.lit(files_per_date)))
    (
        dated.repartition("date", "_part")
        .sortWithinPartitions("date", "_part", "area", "t_index")
        .drop("_part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("date")
        .parquet(path)
    )


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """A result table as parquet (zstd), CSV with header, or JSON lines, optionally one folder per key."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"no such table format: {fmt}")


def append_log(records: DataFrame, path: str) -> None:
    """Append experiment rows; nothing is written if any lacks a model or a rationale.

    ``hyperparams`` may be a map or struct column; it is stored as JSON text. Every append has the same columns with the
    same types, whichever of them ``records`` lacks; a column that the log does not know is refused.
    """
    unknown = sorted(set(records.columns) - {*LOG_COLUMNS, "hyperparams"})
    if unknown:
        raise PanelError(f"the experiment log has no columns {unknown}")
    records = durable(records, "log-rows")  # checked and written from one evaluation
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = records.filter(blank(F.col("model")) | blank(F.col("rationale_for_next_change")))
    demand_empty(bad, "experiment rows need a model and a rationale")
    rows = records
    if "hyperparams" in rows.columns:
        rows = rows.withColumn("hyperparams_json", F.to_json("hyperparams")).drop("hyperparams")
    have = set(rows.columns)
    typed = [(F.col(c) if c in have else F.lit(None)).cast(LOG_NUMBERS.get(c, "string")).alias(c) for c in LOG_COLUMNS]
    rows.select(*typed).write.mode("append").parquet(path)
