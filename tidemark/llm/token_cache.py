"""Token counts by way of a digest cache.

A text's key is the SHA-256 of its content together with the digest of the tokenizer file.
Content is normalised no further than null to empty, for the tokenizers at hand count every
byte.  Known keys are joined to the stored counts; of the others each distinct content is
encoded once, and its count appended to the cache, which is a Parquet table.  Appending
writes whole files with the job, so that a lost executor leaves no half entries behind.

A ``.json`` file is read by the tokenizers library, a ``.model`` by sentencepiece: the counts are
the library's own.  Special strings inside texts are tokens of their own where the library's default
has it so.  Repeated rows get a row each.  Columns besides the id and the text pass through unless
they clash with the result's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "version string, digest string, n_tokens long"


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=8)
def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def content_digest(text: Column, version: str) -> Column:
    return F.sha2(F.concat(F.lit(version + "\n"), F.coalesce(text, F.lit(""))).cast("binary"), 256)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``, empty where there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, n_tokens and over_limit (n_tokens > ``limit``)."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    others = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit", "__digest")]
    keyed = docs.withColumn("__digest", content_digest(F.col(text), version))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                n = count(part.column(1).to_pylist())
                yield pa.record_batch({"version": pa.array([version] * len(n), pa.string()), "digest": part.column(0), "n_tokens": pa.array(n, pa.int64())})

    known = open_cache(spark, cache_path).where(F.col("version") == version).select(F.col("digest").alias("__digest"), "n_tokens")
    wanted = keyed
    if not known.isEmpty():
        # Digests alone are compared with the cache; only texts whose digest is missing move on.
        fresh = keyed.select("__digest").distinct().join(known, "__digest", "left_anti")
        wanted = keyed.join(fresh, "__digest", "left_semi")
    # Copies meet in the tasks, so that a content that many rows share is moved once a task.
    misses = wanted.groupBy("__digest").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)

    stored = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version)
    # Two runs at a time may both have appended a content; its counts agree.
    stored = stored.groupBy(F.col("digest").alias("__digest")).agg(F.min("n_tokens").alias("n_tokens"))
    sized = keyed.select(*others, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), "__digest")
    return sized.join(stored, "__digest").select(*others, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
