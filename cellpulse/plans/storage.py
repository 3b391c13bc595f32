"""Where intermediate results live: the shared checkpoint folder named by the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``.

    Only a session whose executor is the driver itself gets a temporary folder of its own; on a cluster,
    a ``local-cluster`` too, a machine-local folder would vanish with its executor, so that case is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    fresh = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", fresh)
    return fresh


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def discard_stages(spark: SparkSession) -> int:
    """Delete every stage written so far; call it once the results that read them are stored or fetched."""
    count = 0
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        count += bool(files.delete(path, True))
    return count


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder, at once, and read it back.

    Used where one derived table feeds several passes: the source is scanned once, the later passes
    see identical rows even when an executor is lost, and the parquet statistics let Catalyst size
    its joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
