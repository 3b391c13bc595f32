"""Incremental ingest of day files.

Records are summed per file, area and step first; what depends on the file or the step alone (its date, its key, the local day)
is worked out on the sums. Then every file is judged: one that holds an unreadable record, an area outside the grid, a record of another day or, where
whole days are asked for, too few steps is refused with its reason, and all others are stored. A refused file never holds up another.

The streaming form keeps its progress in the query checkpoint: a file is taken once and a second run finds nothing to do. The sink
replaces the partition of each source file, so a repeated batch changes nothing, a day may arrive in several files, and no
result depends on arrival order. The batch form takes pending days in date order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators import panel as P
from cellpulse.operators.quality import PanelError, demand_empty
from cellpulse.plans.series import spread
from cellpulse.settings import PanelSpec
from cellpulse.sources.readers import file_date, kept_fields, list_day_files, undated_files

CELLS_PER_PART = 200_000
SHOWN = 5


def file_cells(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Partial sums ``(file, area, t_index, value, n_rows)``; an unreadable area or time is NULL and keeps its rows."""
    keyed = raw.select("file", "square_id", P.step_of_ms("time_ms", spec).alias("t_index"), F.coalesce("internet", F.lit(spec.null_fill)).alias("internet"))
    summed = keyed.groupBy("file", "square_id", "t_index").agg(F.sum("internet").alias("value"), F.count(F.lit(1)).alias("n_rows"))
    return summed.withColumnRenamed("square_id", "area").withColumn("area", F.col("area").cast("long"))


def judge_files(cells: DataFrame, spec: PanelSpec, whole_days: bool = False) -> DataFrame:
    """One row per file: ``(file, date, file_key, n_rows, n_cells, n_steps, reason)``; a file to be stored has no reason.

    With ``whole_days`` the files of a date must hold all steps of a day together.
    """
    steps = cells.groupBy("file", "t_index").agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"), F.min("area").alias("low"), F.max("area").alias("high"),
        F.count_if(F.col("area").isNull() | F.col("t_index").isNull()).alias("unread"),
    )
    day = X.local_day(X.to_local(X.step_time("t_index", spec), spec.tz))
    dated = steps.withColumn("date", file_date(F.col("file"))).withColumn("day", day)
    files = dated.groupBy("file", "date").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_cells").alias("n_cells"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("unread").alias("unread"),
        F.min(F.when(F.col("day") != F.col("date"), F.col("day"))).alias("other"), F.count_if(F.col("day") == F.col("date")).alias("n_steps"),
    )
    told = [
        (F.col("date").isNull(), F.lit("no date in the file name")),
        (~F.col("date").between(F.lit(spec.start), F.lit(spec.end)), F.format_string("day %s outside the period", F.col("date").cast("string"))),
        (F.col("unread") > 0, F.format_string("%d cells of unreadable records", "unread")),
        (F.col("low") < 1, F.format_string("area id outside the grid: %d", "low")),
        (F.col("high") > spec.n_areas, F.format_string("area id outside the grid: %d", "high")),
        (F.col("other").isNotNull(), F.format_string("record of another day: %s", F.col("other").cast("string"))),
    ]
    if whole_days:
        seen = dated.filter("day = date").groupBy("date").agg(F.countDistinct("t_index").alias("_seen"))
        files = files.join(seen, "date", "left")
        told.append((F.coalesce("_seen", F.lit(0)) != spec.daily, F.format_string(f"day has %d of {spec.daily} steps", F.coalesce("_seen", F.lit(0)))))
    reason = F.coalesce(*[F.when(wrong, text) for wrong, text in told])
    return files.select("file", "date", F.md5("file").alias("file_key"), "n_rows", "n_cells", "n_steps", reason.alias("reason"))


def day_cells(cells: DataFrame, files: DataFrame) -> DataFrame:
    """``(date, file_key, part, area, t_index, value, n_rows)`` of the files that ``files`` lists."""
    parts = F.ceil(F.col("n_cells") / CELLS_PER_PART)
    joined = cells.join(F.broadcast(files.select("file", "date", "file_key", "n_cells")), "file")
    return joined.select("date", "file_key", F.pmod(F.xxhash64("area"), parts).alias("part"), "area", "t_index", "value", "n_rows")


def store_cells(cells: DataFrame, target: str) -> None:
    """Replace the partitions of the source files in ``cells``; each is written by as many tasks as it has parts."""
    (
        spread(cells, "date", "file_key", "part")
        .drop("part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("date", "file_key")
        .parquet(target)
    )


def refused_path(target: str) -> str:
    return f"{target.rstrip('/')}-refused"


def take_files(raw: DataFrame, target: str, spec: PanelSpec, whole_days: bool = False) -> list:
    """Store the good files of ``raw`` and record the others; returns the refused ones as rows of (file, reason).

    The sums are kept on disk between judging and storing; if they are lost with an executor, Spark reads those files again.
    A broadcast or a list here has one row per file of the batch.
    """
    cells = file_cells(raw, spec).persist()
    try:
        files = judge_files(cells, spec, whole_days)
        judged = files.collect()
        spark = raw.sparkSession
        good = [r for r in judged if r["reason"] is None]
        bad = [r for r in judged if r["reason"] is not None]
        if good:
            store_cells(day_cells(cells, spark.createDataFrame(good, files.schema)), target)
        if bad:
            rows = spark.createDataFrame(bad, files.schema).withColumn("refused_at", F.current_timestamp())
            rows.coalesce(1).write.mode("append").parquet(refused_path(target))
        return [(r["file"], r["reason"]) for r in bad]
    finally:
        cells.unpersist()


def refused_files(spark: SparkSession, target: str) -> DataFrame:
    """Every refusal so far: ``(file, date, file_key, n_rows, n_cells, n_steps, reason, refused_at)``."""
    return spark.read.parquet(refused_path(target))


def _demand_none(refused: list) -> None:
    if refused:
        raise PanelError(f"{len(refused)} files refused, all others are stored: {refused[:SHOWN]}")


def stored_rollup(spark: SparkSession, target: str) -> DataFrame:
    """The rolled-up cells of everything ingested so far."""
    return (
        spark.read.parquet(target)
        .groupBy("area", "t_index")
        .agg(F.sum("value").alias("value"), F.sum("n_rows").alias("n_rows"))
    )


def ingest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    spec: PanelSpec,
    files_per_trigger: int = 64,
    glob: str | None = None,
    *,
    whole_days: bool = False,
    allow_refused: bool = False,
) -> int:
    """Take every file not taken yet, a few per micro-batch, then stop. Returns the batches run.

    Refused files are recorded under ``refused_path``; unless they are allowed, they are named in an error once everything else is stored.
    A corrected file of the same name is not offered again by the stream; ``ingest_pending`` takes it.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = kept_fields(reader.text(source))
    batches, refused = [], []

    def take(batch: DataFrame, batch_id: int) -> None:
        refused.extend(take_files(batch, target, spec, whole_days))
        batches.append(batch_id)

    query = raw.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not allow_refused:
        _demand_none(refused)
    return len(batches)


def pending_files(spark: SparkSession, source: str, target: str, glob: str = "*", force: bool = False) -> DataFrame:
    """Day files neither stored nor, since they were last changed, refused."""
    files = list_day_files(spark, source, glob).withColumn("file_key", F.md5("path"))
    if force:
        return files
    try:
        files = files.join(spark.read.parquet(target).select("file_key").distinct(), "file_key", "left_anti")
    except AnalysisException:
        pass  # nothing is stored yet
    try:
        refused = refused_files(spark, target).groupBy("file_key").agg(F.max("refused_at").alias("refused_at"))
    except AnalysisException:
        return files
    return files.join(refused, "file_key", "left").filter("refused_at is null or changed_at > refused_at").drop("refused_at")


def ingest_pending(
    spark: SparkSession,
    source: str,
    target: str,
    spec: PanelSpec,
    *,
    limit: int | None = None,
    force: bool = False,
    glob: str = "*",
    days_per_batch: int = 16,
    whole_days: bool = False,
    allow_refused: bool = False,
) -> int:
    """Batch form: pending days in date order, at most ``limit`` of them, ``force`` takes all again. Returns the days taken.

    Days are written in groups; a refused file is recorded and, unless allowed, named in an error after the last group. Only file names and
    one row per file reach the driver, never records.
    """
    demand_empty(undated_files(list_day_files(spark, source, glob)), "files without a date in their name")
    names = pending_files(spark, source, target, glob, force).select("date", "path").orderBy("date", "path").collect()
    days: dict = {}
    for row in names:
        days.setdefault(row["date"], []).append(row["path"])
    wanted = list(days)[: limit if limit is not None else len(days)]
    refused = []
    for start in range(0, len(wanted), days_per_batch):
        paths = [p for d in wanted[start : start + days_per_batch] for p in days[d]]
        refused += take_files(kept_fields(spark.read.text(paths)), target, spec, whole_days)
    if not allow_refused:
        _demand_none(refused)
    return len(wanted)
