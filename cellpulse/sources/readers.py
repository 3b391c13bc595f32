"""Sources: call-record text, grid geometry, run logs, stored panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellpulse.operators.quality import PanelError
from cellpulse.sources.digests import TASK_BYTES, file_digests

# Column order of the headerless day files.
CDR_SCHEMA = T.StructType(
    [
        T.StructField("square_id", T.IntegerType()),
        T.StructField("time_ms", T.LongType()),
        T.StructField("country_code", T.IntegerType()),
        T.StructField("sms_in", T.DoubleType()),
        T.StructField("sms_out", T.DoubleType()),
        T.StructField("call_in", T.DoubleType()),
        T.StructField("call_out", T.DoubleType()),
        T.StructField("internet", T.DoubleType()),
    ]
)

KEPT = ("square_id", "time_ms", "internet")


def scan_cdr(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = KEPT, with_file: bool = False) -> DataFrame:
    """Headerless tab-separated records under the declared schema; an empty field is NULL.

    Nothing is inferred, so there is no extra pass, and the CSV reader converts only the kept columns.
    """
    rows = spark.read.schema(CDR_SCHEMA).option("sep", "\t").csv(path)
    extra = [F.col("_metadata.file_path").alias("file")] if with_file else []
    return rows.select(*columns, *extra)


def kept_fields(lines: DataFrame) -> DataFrame:
    """``KEPT`` and the file from raw text lines, cut at tabs by plain string functions.

    Faster than the CSV reader where whole files are summed up. An empty or unreadable field is NULL; the activity is the last field.
    """
    cut = {"square_id": "substring_index(value, '\t', 1)", "time_ms": "substring_index(substring_index(value, '\t', 2), '\t', -1)", "internet": "substring_index(value, '\t', -1)"}
    kinds = {f.name: f.dataType.simpleString() for f in CDR_SCHEMA}
    return lines.select(*[F.expr(f"try_cast({cut[c]} AS {kinds[c]}) AS {c}") for c in KEPT], F.col("_metadata.file_path").alias("file"))


def file_date(path: Column) -> Column:
    """Date in the last three ``-`` parts of the file stem, else of a ``date=`` folder; NULL if neither."""
    stem = F.regexp_extract(path, r"(?:^|[-/])(\d{4}-\d{2}-\d{2})(?:\.[A-Za-z0-9.]+)?$", 1)
    folder = F.regexp_extract(path, r"(?:^|/)date=(\d{4}-\d{2}-\d{2})/[^/]*$", 1)
    return F.try_to_date(F.when(stem != "", stem).when(folder != "", folder), "yyyy-MM-dd")


def list_day_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, date, length, changed_at)`` of the day files; content is pruned away, so no file is opened."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )
    return files.select("path", file_date(F.col("path")).alias("date"), "length", F.col("modificationTime").alias("changed_at"))


def undated_files(files: DataFrame) -> DataFrame:
    """Files whose name carries no date; must be empty before an ingest."""
    return files.filter("date is null")


def file_integrity_audit(spark: SparkSession, path: str, manifest: DataFrame, glob: str = "*", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Size and MD5 of each file against the published ``(name, length, md5)``.

    The digest is computed where the file is read, large files range by range, so only names, sizes and digests are joined.
    """
    named = file_digests(spark, path, glob, task_bytes=task_bytes)
    wanted = manifest.select("name", F.col("length").alias("expected_length"), F.col("md5").alias("expected_md5"))
    joined = named.join(wanted, "name", "full_outer")
    same_size = F.col("length") == F.col("expected_length")
    status = (
        F.when(F.col("length").isNull(), "missing")
        .when(F.col("expected_length").isNull(), "unlisted")
        .when(~same_size, "size differs")
        .when(F.col("md5") == F.col("expected_md5"), "match")
        .otherwise("digest differs")
    )
    return joined.select("name", "length", "expected_length", status.alias("status"))


def scan_grid_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Ring vertices of every grid cell: ``(cell_id, pos, lon, lat)``.

    ``lines`` reads one feature per line, which splits over tasks; a single FeatureCollection document
    can only be parsed by one task.
    """
    feature = "struct<properties: struct<cellId: bigint>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>"
    if lines:
        rows = spark.read.text(path).select(F.from_json("value", feature).alias("f"))
    else:
        doc = spark.read.schema(f"type string, features array<{feature}>").option("multiLine", "true").json(path)
        rows = doc.select(F.explode("features").alias("f"))
    ring = F.posexplode(F.col("f.geometry.coordinates")[0]).alias("pos", "point")
    return rows.select(F.col("f.properties.cellId").alias("cell_id"), ring).select(
        "cell_id", "pos", F.col("point")[0].alias("lon"), F.col("point")[1].alias("lat")
    )


# Fixed value: the shape of a day line in the run log.
DAY_LINE = (
    r"\[\s*(\d+)/(\d+)\]\s+(\d{4}-\d{2}-\d{2})\s+dl\s+([\d.]+)s\s+ingest\s+([\d.]+)s\s+"
    r"([\d,]+)\s+rows\s+absent\s+(\d+)\s+peak\s+(\d+)\s+MiB"
)


def notebook_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text output of executed notebooks as one line per row."""
    schema = "cells array<struct<outputs: array<struct<text: array<string>, data: struct<`text/plain`: array<string>>>>>>"
    books = spark.read.schema(schema).option("multiLine", "true").json(path)
    outputs = books.select(F.explode("cells").alias("c")).select(F.explode("c.outputs").alias("o"))
    text = F.array_join(F.coalesce(F.col("o.text"), F.col("o.data.`text/plain`")), "")
    return outputs.select(F.explode(F.split(text, "\n")).alias("value"))


def scan_run_log(lines: DataFrame, cells_per_day: int) -> DataFrame:
    """Day lines of a run log as typed columns; other lines are skipped."""
    hits = lines.filter(F.col("value").rlike(DAY_LINE))
    part = lambda i: F.regexp_extract("value", DAY_LINE, i)
    return hits.select(
        F.to_date(part(3)).alias("date"),
        part(4).cast("double").alias("download_s"),
        part(5).cast("double").alias("ingest_s"),
        F.regexp_replace(part(6), ",", "").cast("long").alias("raw_rows"),
        part(7).cast("long").alias("absent_cells"),
        part(8).cast("long").alias("peak_rss_mib"),
    ).select(
        "*",
        (F.col("absent_cells") / F.lit(cells_per_day)).alias("absent_fraction"),
        F.round(F.col("download_s") + F.col("ingest_s"), 2).alias("total_s"),
    )


def scan_panel(spark: SparkSession, path: str, areas: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored panel, only the asked-for areas and columns; both reach the parquet scan.

    An area that is not stored is an error naming it.
    """
    panel = spark.read.parquet(path)
    if areas is not None:
        panel = panel.filter(F.col("area").isin(list(areas)))
        found = {row[0] for row in panel.select("area").distinct().collect()}  # at most the ids asked for
        absent = [a for a in areas if a not in found]
        if absent:
            raise PanelError(f"no stored series for areas {absent}; found {sorted(found)}")
    return panel.select(*columns) if columns else panel
