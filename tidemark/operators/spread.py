"""Sums and joins of large graphs in tasks of bounded size, also where one node has most of the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a task on average, and those from which on more than one task is worth it.
TASK_ROWS, LEAST_ROWS = 1 << 19, 1 << 13
#: Parts in which the rows of one key are first put together.
SALTS = 16
#: Rows of a key that is joined by a broadcast, so that they stay where they are.
HUB_ROWS = 1 << 16


def tasks(frame: DataFrame, rows: int) -> int:
    """In how many tasks so many rows are dealt out; it grows with them, whatever the session's number of partitions."""
    return max(1, min(frame.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS), -(-rows // TASK_ROWS))


def salt(value: str | Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")


def least(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, m, n): the least value of each key and how many rows it has, in ``n`` tasks; a key's rows are first put together by parts."""
    parts = rows.withColumn("salt", salt(value)).repartition(n, key, "salt").groupBy(key, "salt").agg(F.min(value).alias("m"), F.count("*").alias("n"))
    return parts.repartition(n, key).groupBy(key).agg(F.min("m").alias("m"), F.sum("n").alias("n"))


def with_least(rows: DataFrame, found: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with the m of their key from (key, m, n), in ``n`` tasks. Keys of many rows are few, and are sent to the rows; the others' side of ``found`` is hashed, so that no rows are sorted."""
    hubs = found.where(F.col("n") > HUB_ROWS).select(F.col(key).alias("hub"), F.col("m").alias("hub_m"))
    told = rows.join(F.broadcast(hubs), F.col(key) == F.col("hub"), "left").drop("hub")
    others = found.where(F.col("n") <= HUB_ROWS).select(key, "m").repartition(n, key).hint("shuffle_hash")
    near = told.where("hub_m IS NULL").drop("hub_m").repartition(n, key).join(others, key)
    return near.unionByName(told.where("hub_m IS NOT NULL").withColumnRenamed("hub_m", "m"))
