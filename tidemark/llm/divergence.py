"""How far sources differ in their words, by joint count histograms.

A language keeps the terms that at least ``least`` of its documents hold.  In a group (a source of a
language, or the whole language) a kept term with ``count`` occurrences, zero included, has the share
``p = 1 + floor(10**9 * (count + 1) / (N + V))``, where N is the group's sum over the V kept terms.
Two shares differ by ``floor((p - q)**2 / q)``.

As a share hangs on the count alone, two sources are compared by how many terms have each pair of counts:
the pairs are tallied in tasks and the difference is taken once a pair of counts, times its number.

Tallies are products of blocks: the sources of a language fall into blocks of about ``SOURCES`` and its
terms into buckets of about ``TERMS``.  A task has two blocks in one bucket as two dense matrices, so that
no rows of pairs are made by term and a source of any size is spread over the buckets.  Terms that neither
block holds aren't sent anywhere: their number is what the tallies lack of V.

Null texts, languages and sources are empty ones.  Repeated rows count as documents of their own.  A group
without kept terms has a row for each other source all the same; a language without kept terms gives 0.
Columns besides the three are not read.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.storage import stored

#: Sources in a block and terms in a bucket, on average: what one task's matrices hold.
SOURCES, TERMS = 64, 512
#: Different (group, term) entries that a task gathers before it sends them on.
HELD = 100_000

COUNTS = "lang string, source string, term string, n long, docs long"
TALLY = "lang string, a string, total_a long, b string, total_b long, kept long, count_a long, count_b long, terms long"

#: Letters, lower-cased if ASCII, and all bytes of other characters stay; the rest parts terms.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            keys = list(terms)
            seen = docs[lang, source]
            columns = [pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(terms.values(), pa.int64()), pa.array([seen[k] for k in keys], pa.int64())]
            yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = Counter(text.encode().translate(_BYTES).split())
            counts[lang, source].update(words)
            docs[lang, source].update(words.keys())
        if sum(map(len, counts.values())) > HELD:
            yield from send()
    yield from send()


def _share(count: str, total: str) -> str:
    """SQL of the share of a term with ``count`` of ``total`` occurrences among ``kept`` terms; decimals, as the product may pass 64 bits."""
    return f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div CAST(greatest({total} + kept, 1) AS DECIMAL(20, 0))"


def _difference(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _tally(rows: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks of sources in one bucket of terms: each pair of sources with the numbers of terms by pair of counts.

    A row without a term says that the source is there.  A pair has a row even where the bucket has no terms.
    """
    lang, left, right = rows["lang"].iloc[0], int(rows["left"].iloc[0]), int(rows["right"].iloc[0])
    terms, _ = pd.factorize(rows["term"])  # -1: none
    size = int(terms.max()) + 1
    counts, coded = np.unique(np.append(rows["n"].to_numpy(), 0), return_inverse=True)
    zero = int(coded[-1])

    def matrix(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's sources, their totals, and their terms' counts as numbers of ``counts``."""
        own = (rows["block"] == block).to_numpy()
        at, names = pd.factorize(rows["source"][own], sort=True)
        codes = np.full((len(names), size), zero, np.int64)
        filled = terms[own] >= 0
        codes[at[filled], terms[own][filled]] = coded[:-1][own][filled]
        totals = np.zeros(len(names), np.int64)
        totals[at] = rows["total"][own]
        return np.asarray(names, object), totals, codes

    names_a, totals_a, codes_a = matrix(left)
    names_b, totals_b, codes_b = (names_a, totals_a, codes_a) if left == right else matrix(right)
    # Per source of the one block: its number, the other's, both counts' numbers, and the terms.
    found = [np.zeros((5, 0), np.int64)]
    for k in range(len(names_a)):
        others = np.arange(k + 1 if left == right else 0, len(names_b))
        cells = (others[:, None] * len(counts) + codes_a[k]) * len(counts) + codes_b[others] if size else (others * len(counts) + zero) * len(counts) + zero
        cells, n = np.unique(cells, return_counts=True)
        pair, code_b = np.divmod(cells, len(counts))
        other, code_a = np.divmod(pair, len(counts))
        found.append(np.stack([np.full(len(n), k), other, code_a, code_b, n if size else 0 * n]))
    a, b, code_a, code_b, n = np.concatenate(found, axis=1)
    columns = {"a": names_a[a], "total_a": totals_a[a], "b": names_b[b], "total_b": totals_b[b], "kept": rows["kept"].iloc[0], "count_a": counts[code_a], "count_b": counts[code_b], "terms": n}
    return pd.DataFrame(columns).assign(lang=lang)


def kept_counts(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, source, term, n, lang_n, is_first): the occurrences of each kept term in each source that has it, and in the language; one source of a term is its first."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counted = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_count_terms, COUNTS)
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    wide = counted.withColumns({"lang_n": F.sum("n").over(same), "__docs": F.sum("docs").over(same), "is_first": F.col("source") == F.min("source").over(same)})
    return wide.where(F.col("__docs") >= least).drop("__docs", "docs")


def source_groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, sources, kept, lang_total, total): each source that occurs, with or without terms; how many its language has, V, and the sums of kept terms."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = counts.groupBy("lang").agg(F.sum(F.col("is_first").cast("long")).alias("kept"), F.sum("n").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    return groups.join(sources.join(langs, "lang", "left"), "lang").join(own, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "total"])


def joint_histograms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, total_a, b, total_b, kept, count_a, count_b, terms): for each two sources of a language, once, the number of terms by pair of counts.

    Terms that a pair lacks and its blocks lack, too, aren't in the tallies.
    """
    placed = groups.select("lang", "source", "total", "kept", F.ceil(F.col("sources") / SOURCES).alias("blocks"), F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1)).alias("buckets"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    held = counts.select("lang", "source", "term", "n").join(placed, ["lang", "source"]).withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets"))
    there = placed.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    rows = held.unionByName(there).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("lang", "bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "source", "total", "kept", "term", "n")
    tallies = rows.groupBy("lang", "left", "right", "bucket").applyInPandas(_tally, TALLY)
    return tallies.groupBy("lang", "a", "total_a", "b", "total_b", "kept", "count_a", "count_b").agg(F.sum("terms").alias("terms"))


def pair_differences(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each source and each other one of its language."""
    cells = joint_histograms(counts, groups)
    cells = cells.withColumns({"p": F.expr(_share("count_a", "total_a")), "q": F.expr(_share("count_b", "total_b")), "p0": F.expr(_share("0", "total_a")), "q0": F.expr(_share("0", "total_b"))})
    cells = cells.withColumns({"ab": F.expr(f"terms * ({_difference('p', 'q')})"), "ba": F.expr(f"terms * ({_difference('q', 'p')})")})
    pairs = cells.groupBy("lang", "a", "b", "p0", "q0", "kept").agg(*[F.sum(c).alias(c) for c in ("ab", "ba", "terms")])
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.expr(f"ab + (kept - terms) * ({_difference('p0', 'q0')})").alias("value")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.expr(f"ba + (kept - terms) * ({_difference('q0', 'p0')})").alias("value")),
        )
    )
    return pairs.select("lang", both.alias("r")).select("lang", "r.source", "r.item", "r.value")


def term_differences(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each kept term that a source has and that has a larger share there than in the language."""
    rows = counts.join(groups, ["lang", "source"]).withColumns({"p": F.expr(_share("n", "total")), "q": F.expr(_share("lang_n", "lang_total"))})
    return rows.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_difference("p", "q")).alias("value"))


def audit(docs: DataFrame, least: int = 3, terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): per source all others of its language (part ``pair``), and the ``terms`` terms it is richest in (``term``)."""
    counts = stored(kept_counts(docs, least), "term-counts")
    groups = stored(source_groups(docs, counts), "source-groups")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_differences(counts, groups).withColumn("rank", place)
    top = term_differences(counts, groups).withColumn("rank", place).where(F.col("rank") <= terms)
    named = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(top, "term"))
