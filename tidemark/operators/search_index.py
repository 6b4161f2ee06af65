"""A kept index of texts: postings by term on disk, searched by BM25 within bounds, updated a document at a time.

Below the index's folder:

* ``postings``, a folder a bucket of terms: rows of a term and a block of documents, with the block's postings, the
  highest count and smallest size in it (which bound all its weights), and one posting that the block surely has;
* ``documents``, a folder a bucket of ids: each document's size and the buckets of its terms;
* ``layout``: the numbers of buckets and blocks, which stay as the index was made.

A query reads the buckets of its terms only.  Terms whose bounds together can't lift a document among the best ``k``
(the k-th best surely reached is known from the blocks) bring in no candidates: their postings are looked
up for documents that other terms have found and that could still get there.  Results are those of a full search.

An update rewrites the buckets of the old and new terms of the documents given, and no others.  Ids must be unique
in the index; of an update's rows with one id any counts once.  Rows without an id are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tidemark.operators.search import tokens
from tidemark.storage import stored

#: Documents in a block of a term that all documents have, on average.
BLOCK_DOCS = 128
#: Blocks whose postings one task writes, of one bucket; the number of tasks grows with the documents.
TASK_BLOCKS = 256
#: Sums of doubles in another order may differ by less; bounds leave that much room.
ROOM = 1e-6
_WORD = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    buckets: int
    blocks: int

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").where("term IS NOT NULL")

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents").where("size IS NOT NULL")


def _bucket(value: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, size, words) of documents, words as (term, tf) with each term once."""
    kind = T.StructType([docs.schema["doc_id"], *docs.sparkSession.createDataFrame([], "size int, words array<struct<term:string,tf:int>>").schema])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [Counter(_WORD.findall((text or "").lower())) for text in part.column(1).to_pylist()]
                words = [[{"term": t, "tf": n} for t, n in c.items()] for c in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.total() for c in found], pa.int32()), pa.array(words, schema.field("words").type)], schema=schema)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(count, kind)


def _postings(counted: DataFrame, index: SearchIndex) -> DataFrame:
    rows = counted.select("doc_id", "size", _bucket("doc_id", index.blocks).alias("block"), F.explode("words").alias("w"))
    return rows.select(_bucket("w.term", index.buckets).alias("bucket"), F.col("w.term").alias("term"), "block", "doc_id", F.col("w.tf").alias("tf"), "size")


def _grouped(postings: DataFrame, index: SearchIndex) -> DataFrame:
    """Rows of a term and a block; those of a bucket meet in as many tasks as its blocks need."""
    parts = -(-index.blocks // TASK_BLOCKS)
    dealt = postings.withColumn("part", F.col("block") % parts)
    tasks = index.buckets * parts
    dealt = dealt.repartition(tasks, "bucket", "part")
    posting = F.struct("doc_id", "tf", "size")
    best = F.max_by(F.struct("tf", "size"), F.col("tf") / (F.col("tf") + F.col("size")))
    return dealt.groupBy("bucket", "part", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("size").alias("min_size"), best.alias("best"), F.collect_list(posting).alias("postings")).drop("part")


def _document_rows(counted: DataFrame, index: SearchIndex) -> DataFrame:
    terms = F.array_sort(F.array_distinct(F.transform("words", lambda w: F.pmod(F.xxhash64(w["term"]), F.lit(index.buckets)).cast("int"))))
    return counted.select(_bucket("doc_id", index.buckets).alias("bucket"), "doc_id", "size", terms.alias("term_buckets"))


def build(docs: DataFrame, path: str, buckets: int = 64) -> SearchIndex:
    """An index of (doc_id, text) in a folder that is empty or absent."""
    spark = docs.sparkSession
    counted = stored(_counted(docs), "counted-words")
    index = SearchIndex(spark, path, buckets, max(1, -(-counted.count() // BLOCK_DOCS)))
    blank = spark.createDataFrame([(0,)], "bucket int")  # so that an index without documents has files, too
    _document_rows(counted, index).unionByName(blank, allowMissingColumns=True).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/documents")
    _grouped(_postings(counted, index), index).unionByName(blank, allowMissingColumns=True).write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([(index.buckets, index.blocks)], "buckets int, blocks int").coalesce(1).write.parquet(f"{path}/layout")
    return index


def load(spark: SparkSession, path: str) -> SearchIndex:
    """The index in a folder."""
    layout = spark.read.parquet(f"{path}/layout").first()
    return SearchIndex(spark, path, layout["buckets"], layout["blocks"])


def _numbers(rows: DataFrame) -> list[int]:
    """The distinct bucket numbers of a column of them: never more than the index has buckets."""
    return sorted(r[0] for r in rows.distinct().collect())


def _overwrite(rows: DataFrame, buckets: list[int], path: str) -> None:
    """Puts rows in the place of those of the buckets; a bucket that is left without any holds a row of nulls."""
    spark = rows.sparkSession
    blank = spark.createDataFrame([(b,) for b in buckets], "bucket int")
    kept = stored(rows.unionByName(blank, allowMissingColumns=True), "index-buckets")
    kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def update(index: SearchIndex, docs: DataFrame, gone: DataFrame | None = None) -> list[int]:
    """Puts (doc_id, text) in the place of what the index has of these ids, and takes out the ids of ``gone``; returns the buckets of terms that it rewrote."""
    fresh = stored(_counted(docs.dropDuplicates(["doc_id"])), "changed-words")
    ids = fresh.select("doc_id") if gone is None else fresh.select("doc_id").union(gone.select("doc_id").where("doc_id IS NOT NULL"))
    ids = stored(ids.distinct(), "changed-ids")
    places = _numbers(ids.select(_bucket("doc_id", index.buckets)))
    here = index.documents().where(F.col("bucket").isin(places))
    told = _document_rows(fresh, index)
    touched = here.join(ids, "doc_id", "left_semi").select(F.explode("term_buckets")).union(told.select(F.explode("term_buckets")))
    buckets = _numbers(touched)
    old = index.postings().where(F.col("bucket").isin(buckets)).select("bucket", "term", "block", F.explode("postings").alias("p")).select("bucket", "term", "block", "p.doc_id", "p.tf", "p.size")
    left = old.join(ids, "doc_id", "left_anti").unionByName(_postings(fresh, index))
    _overwrite(_grouped(left, index), buckets, f"{index.path}/postings")
    _overwrite(here.join(ids, "doc_id", "left_anti").unionByName(told), places, f"{index.path}/documents")
    return buckets


def search(index: SearchIndex, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) of the ``k`` best documents for each of queries (query_id, text), a query term once; idf = ln(1 + (N - n + 0.5) / (n + 0.5))."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked = stored(asked.distinct().withColumn("bucket", _bucket("term", index.buckets)), "asked-terms")
    wanted = _numbers(asked.select("bucket"))
    rows = index.postings().where(F.col("bucket").isin(wanted)).join(asked.select("term").distinct(), "term", "left_semi")
    sizes = F.broadcast(index.documents().agg(F.count("*").alias("n_docs"), F.avg("size").alias("avg_size")))  # one row
    weight = lambda tf, size: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / F.col("avg_size")))

    bounded = rows.select("term", "block", "n", "max_tf", "min_size", "best").crossJoin(sizes)
    bounded = bounded.withColumns({"upper": weight(F.col("max_tf"), F.col("min_size")), "sure": weight(F.col("best.tf"), F.col("best.size"))})
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("sure")))
    reached = bounded.select("term", "sure").withColumn("place", place).where(F.col("place") <= k).groupBy("term").agg(F.max(F.when(F.col("place") == k, F.col("sure"))).alias("kth"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = bounded.groupBy("term", "n_docs", "avg_size").agg(F.sum("n").alias("df"), F.max("upper").alias("upper")).join(reached, "term").withColumn("idf", idf)
    of_query = Window.partitionBy("query_id")
    plan = asked.select("query_id", "term").join(terms, "term").withColumns({"upper": F.col("upper") * F.col("idf"), "kth": F.coalesce(F.col("kth") * F.col("idf"), F.lit(0.0))})
    plan = plan.withColumns({"sure": F.max("kth").over(of_query), "upto": F.sum("upper").over(of_query.orderBy("upper", "term"))})
    plan = stored(plan.withColumn("leads", F.col("upto") >= F.col("sure") - ROOM), "query-plan")

    part = weight(F.col("p.tf"), F.col("p.size")) * F.col("idf")
    leading = plan.where("leads").select("query_id", "term", "idf", "avg_size").join(rows.select("term", F.explode("postings").alias("p")), "term")
    partial = stored(leading.groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(F.sum(part).alias("part")), "partial-scores")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part")))
    kth = partial.withColumn("place", best).where(F.col("place") <= k).groupBy("query_id").agg(F.max(F.when(F.col("place") == k, F.col("part"))).alias("kth"))
    bounds = plan.groupBy("query_id").agg(F.max("sure").alias("sure"), F.coalesce(F.max(F.when(~F.col("leads"), F.col("upto"))), F.lit(0.0)).alias("rest"))
    open_ = partial.join(kth.join(bounds, "query_id"), "query_id").where(F.col("part") + F.col("rest") >= F.greatest("sure", F.coalesce("kth", F.lit(0.0))) - ROOM).select("query_id", "doc_id", "part")

    followers = plan.where("NOT leads").select("query_id", "term", "idf", "avg_size")
    probed = open_.join(followers, "query_id").withColumn("block", _bucket("doc_id", index.blocks))
    hit = F.get(F.filter("postings", lambda p: p["doc_id"] == F.col("doc_id")), F.lit(0))
    looked = probed.join(rows.select("term", "block", "postings"), ["term", "block"]).withColumn("p", hit).where("p IS NOT NULL").select("query_id", "doc_id", part.alias("part"))
    scores = open_.unionByName(looked).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
