"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into equal segments; of each the mean and the deviation are kept, coarse
(few segments) to fine.  For two vectors and a segment of length l,

    sum (x - y)^2  >=  l * (mean_x - mean_y)^2 + l * (dev_x - dev_y)^2

so that each level bounds the distance from below.  As the inner product is
(|x|^2 + |y|^2 - distance^2) / 2 and norms are known, a lower bound of the distance is an
upper bound of the score, sum l * (mean_x * mean_y + dev_x * dev_y).  A candidate whose bound
is below a query's k-th best score so far is left at that level; exact scores are computed
only for survivors of all levels, in integers.

Work is dealt out as (query block, candidate block) pairs: each side is sent once per block of
the other side, a pair is one task's bounded work, and each pair hands on k rows a query.
Blocks hold at most ``block_rows`` rows and ``block_bytes`` bytes on average, whatever the table's size;
there are no caps, and results are exact.

Vectors that are null or hold null or non-finite components take no part.  Shorter vectors count
as filled up with zeros, so that an empty one scores 0.  Every row is a candidate, repeated ones each,
but for rows with the query's own id; a query that is repeated with the same vector asks once.  Scores beyond 64 bits are cut to the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers of segments, coarse to fine.
LEVELS = (4, 16)


def whole_parts(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component, null if any is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for row, vector in enumerate(column):
        out[row, : len(vector)] = vector
    return out


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that their inner product bounds the score."""
    length = -(-x.shape[1] // segments)
    cut = np.zeros((len(x), segments * length))
    cut[:, : x.shape[1]] = x
    cut = cut.reshape(len(x), segments, length)
    return np.concatenate([cut.mean(2), cut.std(2)], axis=1) * np.sqrt(length)


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one candidate block for each query of one block."""
    width = max(1, max(map(len, queries["v"])), max(map(len, rows["v"])))
    q, x = _matrix(queries["v"], width), _matrix(rows["v"], width)
    q_ids, ids = queries["id"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
    # Whole numbers are exact in doubles up to 2**53.
    exact = width * np.abs(q).max() * np.abs(x).max() < 2.0**53
    levels = [(_statistics(q, s), _statistics(x, s)) for s in LEVELS if s < width]
    slack = 1e-9 * (1.0 + np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1)).max())

    def scores(i: int, at: np.ndarray) -> np.ndarray:
        if exact:
            return (x[at] @ q[i]).astype(np.int64)
        whole = [sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)) for j in at]
        return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in whole], np.int64)

    found = []
    for low in range(0, len(q), 256):
        part = range(low, min(low + 256, len(q)))
        coarse = levels[0][0][part.start : part.stop] @ levels[0][1].T if levels else None
        for i in part:
            others = ids != q_ids[i]
            alive = np.flatnonzero(others)
            if levels and len(alive) > 4 * k:
                bound = np.where(others, coarse[i - low], -np.inf)
                first = np.argpartition(-bound, 4 * k - 1)[: 4 * k]
                least = np.partition(scores(i, first), len(first) - k)[len(first) - k] - slack[i]
                alive = np.flatnonzero(bound >= least)
                for at_query, at_row in levels[1:]:
                    alive = alive[at_row[alive] @ at_query[i] >= least]
            got = scores(i, alive)
            best = np.lexsort((ids[alive], -got.astype(object) if not exact else -got))[:k]
            found.append((np.full(len(best), q_ids[i]), ids[alive][best], got[best]))
    parts = [np.concatenate(c) for c in zip(*found, strict=True)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))


def top_k(vectors: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", is_query: Column | None = None, scale: float = 64.0, block_rows: int = 65_536, block_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest integer inner product, ties to smaller ids.

    ``is_query`` picks the queries among the rows, by default those whose id is divisible by 20.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col(vec_id).cast("long").alias("id"), whole_parts(F.col(vector), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    if is_query is None:
        is_query = F.col("id") % 20 == 0
    asked = usable.where(is_query)
    total, widest = usable.agg(F.count("*"), F.max(F.size("v"))).first()
    n_queries = asked.count()
    block_rows = max(1, min(block_rows, block_bytes // (8 * max(1, widest or 0))))
    row_blocks = max(-(-total // block_rows), 2 * spark.sparkContext.defaultParallelism)
    query_blocks = max(1, -(-n_queries // block_rows))

    def dealt(frame: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(own_blocks)).cast("int")
        return frame.select("id", "v", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other))

    rows = dealt(usable, "rb", row_blocks, "qb", query_blocks)
    queries = dealt(asked, "qb", query_blocks, "rb", row_blocks)

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        repeated = pd.Series(list(zip(queries["id"], map(bytes, queries["v"].map(lambda v: np.asarray(v, np.int64))), strict=True))).duplicated()
        return search_block(queries[~repeated.to_numpy()].reset_index(drop=True), rows, k)

    best = queries.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
