"""Web pages, nested JSON, chunks and tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): the title element, or else the first h1, without tags and outer space."""
    title, h1 = (F.nullif(F.trim(F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit("")) for tag in ("title", "h1"))
    return pages.select("page_id", F.coalesce(title, h1).alias("title"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link, place): distinct link targets of a page in order, without fragments."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    cleaned = F.transform(found, lambda x: F.regexp_replace(x, "#.*$", ""))
    kept = F.array_distinct(F.filter(cleaned, lambda x: x != ""))
    return pages.select("page_id", F.posexplode(kept).alias("place", "link"))


def schema_of(rows: DataFrame, column: str) -> DataFrame:
    """(path, types) of flat JSON objects: the types that occur at each key, joined by |."""
    pairs = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?\d+$"), "int").when(F.col("value").rlike(r"^-?\d+\.\d+$"), "float").when(F.col("value").isin("true", "false"), "bool").otherwise("string")
    return pairs.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(kind)), "|").alias("types"), F.count("*").alias("n"))


def longest_prefix(rows: DataFrame, path: Column, hints: DataFrame) -> DataFrame:
    """``rows`` with the label of the longest hint (prefix, label) that their path starts with, by whole segments.

    Paths are exploded into their prefixes and joined by equality, which needs no nested loop.
    """
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    probed = rows.withColumn("prefix", F.explode(prefixes)).join(hints, "prefix")
    return probed.groupBy(*rows.columns).agg(F.max_by("label", F.length("prefix")).alias("label"))


def _packed(text: str | None, size: int) -> list[str]:
    done, held, length = [], [], 0
    for line in (text or "").split("\n"):
        if held and length + 1 + len(line) > size:
            done.append("\n".join(held))
            held, length = [], 0
        length += len(line) + bool(held)
        held.append(line)
    return [*done, "\n".join(held)]


def chunks(docs: DataFrame, size: int = 2000) -> DataFrame:
    """(doc_id, chunk, text): lines packed greedily into chunks of at most ``size`` characters; a longer line is a chunk.

    Packing has a state from line to line, so that it runs over Arrow batches, linear in the text.
    """

    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _packed(t, size))

    pack = F.pandas_udf(packed, "array<string>")
    return docs.select("doc_id", F.posexplode(pack("text")).alias("chunk", "text"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before each row's time, by one sort of both."""
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(1)).unionByName(right.select(by, at, F.col(value).alias("__v"), F.lit(0).alias("__left")), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value + "_before", F.last("__v", ignorenulls=True).over(order)).where("__left = 1").drop("__v", "__left")


def unique_match(rows: DataFrame, candidates: DataFrame, key: str, target: str) -> DataFrame:
    """Rows joined to their candidate where there is exactly one."""
    single = candidates.groupBy(key).agg(F.countDistinct(target).alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")
    return rows.join(single, key)


def markdown_rows(rows: DataFrame, order: str) -> DataFrame:
    """(place, line): a table row of each row, with bars and backslashes escaped; nulls are empty."""
    cells = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([\\|])", r"\\$1"), "\n", " ") for c in rows.columns]
    return rows.select(F.col(order).cast("long").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def table_cells(pages: DataFrame, tag: str = "li") -> DataFrame:
    """(page_id, place, cell): texts of the elements of a tag, in order, without inner tags."""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("place", "cell")).withColumn("cell", F.trim(F.regexp_replace("cell", "<[^>]*>", "")))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))


# Shapes of lines.
KEY_VALUE = r"^[A-Za-z][A-Za-z0-9 _-]{0,39}:\s+\S"
BULLET = r"^\s*[-*+]\s+\S"
NUMBERED = r"^\d+(\.\d+)*\.?\s+\S"
CAPITALS = r"^[A-Z][A-Z0-9 ]{2,}$"
FOOTERS = ("confidential", "proprietary", "internal use only")


def line_kinds(docs: DataFrame) -> DataFrame:
    """(kind, n) of all lines: blank, bullet, numbered, heading, pair or text."""
    t = F.col("text")
    kind = F.when(F.trim(t) == "", "blank").when(t.rlike(BULLET), "bullet").when(t.rlike(NUMBERED), "numbered").when(t.rlike(CAPITALS), "heading").when(t.rlike(KEY_VALUE), "pair").otherwise("text")
    return _lines(docs).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def pair_runs(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, first_line, n): runs of consecutive ``key: value`` lines, which make one table each."""
    pairs = _lines(docs).where(F.col("text").rlike(KEY_VALUE))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    runs = pairs.withColumn("run", F.col("line") - place).groupBy("doc_id", "run").agg(F.min("line").alias("first_line"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select("doc_id", "first_line", "n")


def without_footers(text: Column) -> Column:
    """The text without lines that hold nothing but a footer's words."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.lower(F.trim(x)).isin(*FOOTERS)), "\n")


def distinct_contents(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, n): documents of equal bytes as one, under the smallest doc_id."""
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def clock(milliseconds: Column) -> Column:
    """h:mm:ss.mmm"""
    whole = F.floor(milliseconds / 1000)
    return F.format_string("%d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, milliseconds % 1000)


def backlinks(found: DataFrame) -> DataFrame:
    """(link, n, first, last): how many distinct pages of (page_id, link) hold each link, and the first and last of them."""
    return found.groupBy("link").agg(F.countDistinct("page_id").alias("n"), F.min("page_id").alias("first"), F.max("page_id").alias("last"))


def sections(docs: DataFrame, clip: int = 4000) -> DataFrame:
    """(doc_id, section, text): Markdown texts without their front matter, split before second-level headings, each cut to ``clip`` characters."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)\A---\n.*?\n---\n", "")
    parts = F.filter(F.split(body, r"(?m)^(?=## )"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("section", "text")).withColumn("text", F.substring("text", 1, clip))
