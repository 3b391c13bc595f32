"""Round trips through every source and sink, on data derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.catalog.features import labelled
from cellpulse.catalog.panel import LOG_SQL, run_log
from cellpulse.catalog.distribution import CELLS, STEP, supplier_positions
from cellpulse.catalog.registry import HOUR, PANEL, PREDICTIONS, query, rounded
from cellpulse.functions import exprs as X
from cellpulse.operators import forecast as FC
from cellpulse.operators import spatial as S
from cellpulse.plans.storage import scratch_path
from cellpulse.sources import readers as R
from cellpulse.sources import testdata as T
from cellpulse.sources import writers as WR
from cellpulse.streaming import ingest as ING


def write_day_files(spark: SparkSession, sf: str, path: str) -> None:
    """The events as headerless tab-separated day files; purchases have an empty activity field."""
    raw = T.events_raw(spark, sf)
    day = X.local_day(X.from_epoch_seconds(F.floor(F.col("time_ms") / 1000)))
    empty = F.lit(None).cast("double")
    (
        raw.select(
            "square_id", "time_ms", "country_code",
            empty.alias("sms_in"), empty.alias("sms_out"), empty.alias("call_in"), empty.alias("call_out"),
            F.when(F.col("country_code") != 44, F.col("internet")).alias("internet"),
            day.alias("date"),
        )
        .repartition("date")
        .write.partitionBy("date")
        .option("sep", "\t")
        .csv(path)
    )


@query(
    "scan_cdr",
    "SELECT CAST(user_id + 1 AS INTEGER) AS square_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS time_ms, CASE WHEN event_type <> 'purchase' THEN value END AS internet, CAST(ts AS DATE) AS date FROM events",
)
def scan_cdr(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cdr")
    write_day_files(spark, sf, path)
    rows = R.scan_cdr(spark, f"{path}/date=*", with_file=True)
    return rows.select("square_id", "time_ms", "internet", R.file_date(F.col("file")).alias("date"))


@query(
    "file_date",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS date FROM events",
)
def file_date(spark: SparkSession, sf: str) -> DataFrame:
    # one file name per event; errors get a name without a date
    stamp = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("2024-13-45"))
    name = F.concat(F.lit("/raw/sms-call-internet-mi-"), stamp, F.lit(".txt"))
    return T.table(spark, sf, "events").select("event_id", R.file_date(name).alias("date"))


@query("list_day_files", "SELECT CAST(ts AS DATE) AS date, 1::BIGINT AS n_files FROM events GROUP BY 1")
def list_day_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cdr")
    write_day_files(spark, sf, path)
    return R.list_day_files(spark, path, "*.csv").groupBy("date").agg(F.count(F.lit(1)).alias("n_files"))


@query("file_integrity_audit")
def file_integrity_audit(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    # one digest and one size of the manifest are wrong on purpose
    manifest = R.file_digests(spark, sf, "*.parquet", recursive=False).select(
        "name",
        F.when(name == "nation.parquet", F.col("length") + 1).otherwise(F.col("length")).alias("length"),
        F.when(name == "region.parquet", F.lit("0")).otherwise(F.col("md5")).alias("md5"),
    )
    return R.file_integrity_audit(spark, sf, manifest, "*.parquet")


@query(
    "ingest_incremental",
    f"WITH o AS (SELECT user_id + 1 AS area, {HOUR} AS t_index, sum(CASE WHEN event_type <> 'purchase' THEN value ELSE 0 END) AS value, count(*) AS n_rows FROM events GROUP BY 1, 2) SELECT area, t_index, round(value, 4) AS value, n_rows FROM o",
)
def ingest_incremental(spark: SparkSession, sf: str) -> DataFrame:
    source, target, progress = (scratch_path(spark, n) for n in ("cdr", "cells", "progress"))
    write_day_files(spark, sf, source)
    spec = T.hourly_spec(spark, sf)
    ING.ingest_stream(spark, source, target, progress, spec, glob="*.csv")
    # nothing is left for a second run
    ING.ingest_stream(spark, source, target, progress, spec, glob="*.csv")
    return rounded(ING.stored_rollup(spark, target), 4)



REFUSED_SQL = f"""
WITH cell AS (SELECT DISTINCT CAST(ts AS DATE) AS date, user_id + 1 AS area, {HOUR} AS t_index FROM events),
days AS (SELECT date, count(*) AS n, min(date) OVER () AS first FROM cell GROUP BY date)
SELECT date, CASE WHEN day(date) % 3 = 1 THEN 'area id outside the grid: 0'
    WHEN day(date) % 3 = 2 AND date > first THEN 'record of another day: ' || CAST(first AS VARCHAR) ELSE 'stored' END AS outcome,
    n + CASE WHEN day(date) % 3 = 1 OR day(date) % 3 = 2 AND date > first THEN 1 ELSE 0 END AS n_cells
FROM days
"""


def write_spoilt_days(spark: SparkSession, sf: str, path: str) -> None:
    """The day files again; a third of them have a record of an area that does not exist, a third one of the first day."""
    raw = T.events_raw(spark, sf)
    rows = raw.select("square_id", "time_ms", "country_code", "internet", X.local_day(X.from_epoch_seconds(F.floor(F.col("time_ms") / 1000))).alias("date"))
    one = rows.groupBy("date").agg(F.min_by("square_id", "time_ms").alias("square_id"), F.min("time_ms").alias("time_ms"))
    first = rows.agg(F.min("time_ms").alias("_t"), F.min_by("square_id", "time_ms").alias("_s"))
    kind = F.day("date") % 3
    extra = one.filter(kind > 0).crossJoin(F.broadcast(first)).select(
        F.when(kind == 1, F.lit(0)).otherwise(F.col("_s")).cast("int").alias("square_id"), F.when(kind == 1, F.col("time_ms")).otherwise(F.col("_t")).alias("time_ms"),
        F.lit(39).alias("country_code"), F.lit(1.0).alias("internet"), "date",
    )
    empty = [F.lit(None).cast("double").alias(c) for c in ("sms_in", "sms_out", "call_in", "call_out")]
    lines = rows.unionByName(extra).select("square_id", "time_ms", "country_code", *empty, "internet", "date")
    lines.repartition("date").write.partitionBy("date").option("sep", "\t").csv(path)


@query("ingest_refused", REFUSED_SQL)
def ingest_refused(spark: SparkSession, sf: str) -> DataFrame:
    """Good and bad day files in one run: what is stored, what is refused and why."""
    source, target = scratch_path(spark, "cdr"), scratch_path(spark, "cells")
    write_spoilt_days(spark, sf, source)
    ING.ingest_pending(spark, source, target, T.hourly_spec(spark, sf), glob="*.csv", allow_refused=True)
    stored = spark.read.parquet(target).groupBy("date").agg(F.lit("stored").alias("outcome"), F.count(F.lit(1)).alias("n_cells"))
    return stored.unionByName(ING.refused_files(spark, target).select("date", F.col("reason").alias("outcome"), "n_cells"))



def write_grid(spark: SparkSession, sf: str) -> str:
    """One GeoJSON feature per supplier cell and line: a closed square around its position."""
    path = scratch_path(spark, "grid")
    corner = lambda a, b: F.array(F.col("longitude") + F.lit(a * STEP / 2), F.col("latitude") + F.lit(b * STEP / 2))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("area").alias("cellId")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    supplier_positions(spark, sf).select(F.to_json(feature).alias("value")).write.text(path)
    return path


@query(
    "scan_grid_geojson",
    f"WITH {CELLS}, k AS (SELECT * FROM (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) v(pos, a, b)) "
    f"SELECT area AS cell_id, pos, round(longitude + a * {STEP} / 2, 7)::DOUBLE AS lon, round(latitude + b * {STEP} / 2, 7)::DOUBLE AS lat FROM pos, k",
)
def scan_grid_geojson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.scan_grid_geojson(spark, write_grid(spark, sf), lines=True), 7)


@query("cell_centroid", f"WITH {CELLS} SELECT area AS cell_id, round(latitude, 7)::DOUBLE AS latitude, round(longitude, 7)::DOUBLE AS longitude FROM pos")
def cell_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.cell_centroid(R.scan_grid_geojson(spark, write_grid(spark, sf), lines=True)), 7)


@query(
    "scan_run_log",
    f"{LOG_SQL} SELECT date, download_s, ingest_s, raw_rows, absent_cells, peak_rss_mib, round(absent_cells / 3600.0, 8)::DOUBLE AS absent_fraction, round(download_s + ingest_s, 2) AS total_s FROM log",
)
def scan_run_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "log")
    line = F.format_string(
        "[%2d/30] %s  dl %6.1fs  ingest %5.1fs  %,d rows  absent %d  peak %5d MiB",
        F.dayofmonth("date"), F.date_format("date", "yyyy-MM-dd"), "download_s", "ingest_s", "raw_rows", "absent_cells", "peak_rss_mib",
    )
    noise = F.concat(F.lit("free disk before "), F.date_format("date", "yyyy-MM-dd"))
    run_log(spark, sf).select(F.explode(F.array(noise, line)).alias("value")).write.text(path)
    return rounded(R.scan_run_log(spark.read.text(path), 3600), 8)


@query("scan_parquet", f"WITH {PANEL} SELECT area, t_index, round(value, 4) AS value FROM panel WHERE area IN (3, 9)")
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "panel")
    WR.sink_panel(labelled(spark, sf)[0].select("area", "t_index", "local", "value"), path)
    return rounded(R.scan_panel(spark, path, (3, 9), ("area", "t_index", "value")), 4)


@query("sink_parquet", f"WITH {PANEL} SELECT CAST(local AS DATE) AS date, count(*) AS n, round(sum(CASE WHEN CAST(local AS DATE) = DATE '2024-01-05' THEN 2 * value ELSE value END), 3) AS total FROM panel GROUP BY 1")
def sink_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "panel")
    rows = labelled(spark, sf)[0].select("area", "t_index", "local", "value")
    WR.sink_panel(rows, path, files_per_date=2)
    # writing one date again replaces that date only
    again = rows.filter(F.to_date("local") == F.lit("2024-01-05").cast("date")).withColumn("value", F.col("value") * 2)
    WR.sink_panel(again, path)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


@query("sink_tables", f"WITH {PREDICTIONS} SELECT model, split, count(*) AS n, round(sum(predicted), 3) AS total FROM pred WHERE model <> 'blend' GROUP BY 1, 2")
def sink_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows, spec = labelled(spark, sf)
    preds = FC.baseline_predictions(rows, spec).select("area", "split", "model", "t_index", "predicted")
    csv, js = scratch_path(spark, "csv"), scratch_path(spark, "json")
    WR.sink_table(preds.filter("split = 'test'"), csv, "csv", by=("model",))
    WR.sink_table(preds.filter("split = 'stress'"), js, "json", by=("model",))
    schema = "area int, split string, t_index long, predicted double, model string"
    back = spark.read.schema(schema).option("header", "true").csv(csv).unionByName(spark.read.schema(schema).json(js))
    return rounded(back.groupBy("model", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("total")), 3)
