"""Bounded samples of rows, by hash or by count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_ids(rows: DataFrame, key: str, size: int, salt: int = 0) -> DataFrame:
    """The ``size`` rows whose keys hash lowest: a sample that no order of the rows changes."""
    return rows.where(F.col(key).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(salt)), key).limit(size)


def with_texts(docs: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` that are in a sample, which is bounded by its size and so broadcast."""
    return docs.join(F.broadcast(sample), key)


def least_count(counts: DataFrame, rows: int) -> int:
    """The least count, to three digits, that at most ``rows`` rows reach; there are at most 900 steps a power of ten."""
    unit = F.pow(F.lit(10), F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))).cast("long")
    steps = counts.groupBy((F.expr("n") - F.col("n") % unit).alias("step")).count().collect()
    least, total = 1 << 62, 0
    for step in sorted(steps, reverse=True):
        total += step["count"]
        if total > rows:
            break
        least = step["step"]
    return least
