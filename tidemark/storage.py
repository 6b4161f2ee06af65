"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set and all tasks run in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once and go on from the written table: later reads don't compute it again."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    table.stored_at = path
    return table


def bucketed(frame: DataFrame, name: str, n: int, by: str) -> DataFrame:
    """As ``stored``, in ``n`` buckets of a column: joins and sums by it don't shuffle the table."""
    path, spark = scratch_path(frame.sparkSession, name), frame.sparkSession
    called = path.rsplit("/", 1)[-1].replace("-", "_")
    frame.write.bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(called)
    table = spark.table(called)
    table.stored_at, table.called = path, called
    _clean(spark)
    return table


def discard(table: DataFrame) -> None:
    """Delete what ``stored`` or ``bucketed`` wrote; only for tables from which all that is still to be read has been written anew."""
    spark = table.sparkSession
    if "called" in vars(table):
        spark.sql(f"DROP TABLE {table.called}")
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _clean(spark)


def _clean(spark: SparkSession) -> None:
    """Spark deletes the files of shuffles that nothing needs any more when the driver collects its garbage, for which this asks."""
    gc.collect()
    spark._jvm.System.gc()


def cut(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint; it ends the lineage of loops."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
