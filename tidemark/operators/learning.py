"""Clusters and term weights by Spark's own library."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tf_idf(docs: DataFrame, text: str = "text", size: int = 4096, least_docs: int = 1) -> DataFrame:
    """``docs`` with features: term counts times idf of the ``size`` most frequent terms, English stop words aside.

    idf = ln((n + 1) / (df + 1)), as the library has it.
    """
    words = RegexTokenizer(inputCol="__text", outputCol="__all", pattern=r"[a-z0-9]{2,}", gaps=False).transform(docs.withColumn("__text", F.coalesce(text, F.lit(""))))
    kept = StopWordsRemover(inputCol="__all", outputCol="__words").transform(words)
    counted = CountVectorizer(inputCol="__words", outputCol="__counts", vocabSize=size, minDF=least_docs).fit(kept).transform(kept)
    return IDF(inputCol="__counts", outputCol="features").fit(counted).transform(counted).drop("__text", "__all", "__words", "__counts")


def k_means(rows: DataFrame, vector: str = "embedding", k: int = 8, seed: int = 42) -> DataFrame:
    """``rows`` with cluster, a number below ``k``; names of clusters are arbitrary."""
    kind = rows.schema[vector].dataType.simpleString()
    ready = rows.withColumn("__vector", F.col(vector) if kind == "vector" else array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(featuresCol="__vector", predictionCol="cluster", k=k, seed=seed).fit(ready)
    return model.transform(ready).drop("__vector")


def cluster_members(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    """(cluster, n, members): the size of each cluster, and its first ``n`` members."""
    sized = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(key))).where(F.col("place") <= n)
    shown = first.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("members"))
    return sized.join(shown, "cluster")
