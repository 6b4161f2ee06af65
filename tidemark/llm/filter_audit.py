"""What each of five filters removes, in whatever order they are applied.

Each document has five failure flags.  A CUBE over the flags and the part sums the documents of every subset
of flags; a row whose chosen flags are all false counts the survivors of that subset of filters.  A step of
an order is a pair of subsets, before and after it, and what it removes is the difference of their survivors.
So the texts are read once, whatever the number of orders.

Filters: A under 200 words; B distinct words under half of all; C capitals A-Z above 3 % of the code points;
D holds any of ``#$%&*|``; E the text is that of a smaller id, anywhere in the table.

Null texts and parts are empty ones.  An empty text has no words: it fails A, not B and C.  A null id isn't smaller
than another and has no smaller one, so that it never fails E nor makes others fail; rows that share the smallest id
of a text don't fail.  Ids with several labels count as good (toxic) if any label says so; no label, neither.
Columns besides the id, text and part are not read.  No documents: no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.storage import stored

FILTERS = "ABCDE"
FLAGS = [f"fails_{f.lower()}" for f in FILTERS]
COUNTS = ["n", "good", "toxic"]


def text_flags(text: Column) -> list[Column]:
    """The failure flags of a text that need no other row, A to D."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals.cast("long") > 3 * F.length(text), text.rlike("[#$%&*|]")]
    return [c.alias(name) for c, name in zip(failed, FLAGS, strict=False)]


def flag_counts(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """(part, the five flags, n, good, toxic): documents by their flags.

    Rows are counted by id and digest before they meet their labels, and by digest and flags before they meet their
    copies, so that a text that a third of the rows shares is a few rows a task by then.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *text_flags(text))
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    marked = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    # Null ids have no labels and no order among copies; they go past the join, in which they would be one key.
    known = once.where("doc_id IS NOT NULL").join(marked, "doc_id", "left").na.fill(False, ["good", "toxic"])
    copies = known.groupBy("digest", "part", *FLAGS[:4], "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", F.col("n").alias("rows"))).alias("least"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    copies = copies.withColumn("firsts", F.when(first, F.col("least.rows")).otherwise(0))
    split = F.explode(F.array(F.struct(F.lit(False).alias("failed"), F.col("firsts").alias("n")), F.struct(F.lit(True).alias("failed"), (F.col("n") - F.col("firsts")).alias("n"))))
    keys = ["part", *FLAGS[:4], "good", "toxic"]
    told = copies.select(*keys, split.alias("s")).select(*keys, F.col("s.failed").alias(FLAGS[4]), F.col("s.n").alias("n"))
    unknown = once.where("doc_id IS NULL").select("part", *FLAGS[:4], F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(False).alias(FLAGS[4]), "n")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return told.unionByName(unknown).groupBy("part", *FLAGS).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def survivors(flags: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): the documents that pass all filters of a subset, whose bit k is filter k; zeros included."""
    cube = flags.cube("part", *FLAGS).agg(F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"any_{f}") for f in FLAGS], *[F.sum(c).alias(c) for c in COUNTS])
    passed = cube.where("all_parts = 0").where(" AND ".join(f"(any_{f} = 1 OR NOT {f})" for f in FLAGS))
    subset = sum(((1 - F.col(f"any_{f}")) * (1 << k) for k, f in enumerate(FLAGS)), F.lit(0)).cast("int")
    found = passed.select("part", subset.alias("subset"), *COUNTS)
    every = flags.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FLAGS)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").na.fill(0, COUNTS)


def steps() -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, subset before, subset after) of all orders."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for place, k in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), place, FILTERS[k], before, before | 1 << k))
            before |= 1 << k
    return rows


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step, with what the step keeps and removes; see the module."""
    spark = docs.sparkSession
    counts = stored(survivors(flag_counts(docs, labels, part)), "filter-survivors")
    orders = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, filter string, before int, after int"))
    whole = (1 << len(FILTERS)) - 1
    # Per filter: the subset that has it alone, and the one that lacks it alone.
    single = F.broadcast(spark.createDataFrame([(f, 1 << k, whole ^ 1 << k) for k, f in enumerate(FILTERS)], "filter string, alone int, others int"))
    named = lambda name, columns: counts.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    paired = named("before", COUNTS).join(orders, "before").join(named("after", COUNTS), ["part", "after"])
    totals = counts.where(f"subset IN (0, {whole})").groupBy("part").agg(F.max(F.when(F.col("subset") == 0, F.col("n"))).alias("documents"), F.max(F.when(F.col("subset") == whole, F.col("n"))).alias("passed"))
    alone = named("alone", ["n"]).join(single, "alone").join(named("others", ["n"]), ["part", "others"]).join(totals, "part")
    alone = alone.select("part", "filter", (F.col("documents") - F.col("alone_n")).alias("failing"), (F.col("others_n") - F.col("passed")).alias("unique_fails"))
    removed = F.col("before_n") - F.col("after_n")
    return paired.join(alone, ["part", "filter"]).select(
        "part",
        "filter_order",
        "step",
        F.col("after_n").alias("kept"),
        removed.alias("removed"),
        (F.col("failing") - removed).alias("redundant"),
        "unique_fails",
        (F.col("before_good") - F.col("after_good")).alias("good_lost"),
        (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"),
        F.sum(removed).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
