"""Sinks: tables as JSON lines, Parquet or Markdown files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.documents import markdown_rows


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_parquet(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_markdown(rows: DataFrame, order: str, path: str) -> None:
    """One line a row, in order over the files."""
    markdown_rows(rows, order).repartitionByRange("place").sortWithinPartitions("place").select("line").write.text(path)


def write_documents(docs: DataFrame, path: str, key: str = "name") -> None:
    """A folder a document of (name, text): Spark writes no single files, so that the name is the folder's."""
    docs.select(F.col(key).alias("document"), F.col("text").alias("value")).write.mode("errorifexists").partitionBy("document").text(path)


def markdown_tree(records: DataFrame, cap: int = 5000) -> DataFrame:
    """(name, text) documents: a summary of levels, and for each level its first ``cap`` records by line with a word on what is left out.

    A document holds ``cap`` lines at most, whatever the level's size.
    """
    counts = records.groupBy("level").agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "level")))
    listed = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["level"], F.lit(": "), (-r["o"]).cast("string"))), "\n")
    summary = counts.agg(F.concat(F.lit("# Levels\n\n"), listed).alias("text")).select(F.lit("summary.md").alias("name"), "text")
    first = records.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("line", "file"))).where(F.col("place") <= cap)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "message"))), lambda r: F.concat(F.lit("- "), F.replace(r["message"], F.lit("\n"), F.lit(" "))))
    body = first.groupBy("level").agg(F.array_join(lines, "\n").alias("lines")).join(counts, "level")
    rest = F.when(F.col("n") > cap, F.concat(F.lit("\n\n"), (F.col("n") - cap).cast("string"), F.lit(" more"))).otherwise("")
    return summary.unionByName(body.select(F.concat(F.lit("raw/"), F.lower("level"), F.lit(".md")).alias("name"), F.concat(F.lit("# "), "level", F.lit("\n\n"), "lines", rest).alias("text")))


def config_hash(config: dict) -> str:
    """The first 16 hex digits of the SHA-256 of the configuration with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def written_with_manifest(rows: DataFrame, path: str, config: dict) -> dict:
    """Writes Parquet and tells, without another pass, how many rows there were, and which configuration made them."""
    seen = Observation("manifest")
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    return {"path": path, "rows": seen.get["rows"], "columns": rows.columns, "config": config_hash(config)}


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a JSON line a node, then one an edge."""
    line = lambda rows: F.to_json(F.struct(*sorted(rows.columns)))
    return nodes.select(F.lit("node").alias("part"), line(nodes).alias("line")).unionByName(edges.select(F.lit("edge").alias("part"), line(edges).alias("line")))


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line): each edge of (src, dst, relation) for Graphviz, quotes escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [label="), quoted(F.coalesce("relation", F.lit("CALLS"))), F.lit("];")).alias("line")).distinct()


def er_lines(keys: DataFrame) -> DataFrame:
    """(line): each foreign key of (src, column, dst) for an entity diagram."""
    return keys.select(F.concat(F.lit("    "), F.upper("dst"), F.lit(" ||--o{ "), F.upper("src"), F.lit(' : "'), "column", F.lit('"')).alias("line")).distinct()


def artifact_json(kind: Column, key: Column, tags: Column, body: Column) -> Column:
    """An artifact as JSON: its kind, id, sorted distinct tags and text."""
    return F.to_json(F.struct(kind.alias("kind"), key.alias("id"), F.array_sort(F.array_distinct(tags)).alias("tags"), body.alias("body")))


def valid_artifact(text: Column) -> Column:
    """Whether a JSON text holds a kind and an id that aren't empty."""
    part = lambda k: F.coalesce(F.get_json_object(text, f"$.{k}"), F.lit("")) != ""
    return part("kind") & part("id")
