"""Sources: tables, lines and nested telemetry as DataFrames."""

from __future__ import annotations

from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.storage import stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_lines(spark: SparkSession, path: str, limit: int | None = None, suffixes: str = "log,txt") -> DataFrame:
    """(file, line, text) of all log and text files below ``path``; lines count from 1 in each file, up to ``limit``.

    Lines of a file must keep their order, so that a file is read whole; ``split_lines`` reads large files in parts.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + suffixes + "}").text(path, wholetext=True)
    lines = files.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "text"))
    lines = lines.select("file", (F.col("at") + 1).alias("line"), "text")
    return lines.where(F.col("line") <= limit) if limit else lines


def split_lines(spark: SparkSession, path: str, suffixes: str = "log,txt") -> DataFrame:
    """(file, line, text) where a large file is read by several tasks: line is the place of a line's block and its number in it,
    which rises along the file, but not by ones."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + suffixes + "}").text(path)
    place = F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id() % (1 << 33)
    return lines.select(F.col("_metadata.file_path").alias("file"), place.alias("line"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str, suffixes: str = "log,txt") -> DataFrame:
    """(file, line, text) where a large file is read by several tasks, and lines count from 1 by ones in each file.

    A first pass counts the lines of each part of a file; sums over the parts before give each its first number. Both
    passes split the files alike, which must stay as they are meanwhile. A file of any size needs no task of its own, and
    no line is moved.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + suffixes + "}").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    parts = stored(rows.groupBy("file", "start").agg(F.min("place").alias("first"), F.count("*").alias("n")), "line-counts")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(offsets, ["file", "start"]).select("file", (F.col("place") + F.col("shift")).alias("line"), "text")


# Names of the fields of a JSON log line, in the order in which they count.
LOG_FIELDS = {
    "level": ["level", "severity", "severityText", "log.level", "level.name", "level.severity"],
    "message": ["message", "msg", "body", "log.message"],
    "ts_text": ["timestamp", "[\'@timestamp\']", "time", "date"],
    "logger": ["logger", "logger_name", "name"],
    "thread": ["thread", "threadName"],
    "user": ["user", "username", "screenname", "user.name", "user.id", "fields.screenname", "fields.user", "attributes.user", "attributes[\'enduser.id\']"],
    "ip": ["ip", "client_ip", "remote_addr", "clientip", "source.ip", "fields.ip", "attributes.ip", "attributes[\'client.address\']"],
}


def json_log(raw: DataFrame, column: str) -> DataFrame:
    """``raw`` with level, message, ts_text, logger, thread, user and ip of JSON log lines, by any of their usual names.

    The level is INFO by default and in capitals; user and ip are put behind the message. Lines that are no JSON object are left out.
    """
    # A line is parsed once; all names are looked up in what it holds.
    lines = raw.withColumn("__held", F.when(F.trim(column).startswith("{"), F.try_parse_json(column))).where("__held IS NOT NULL")
    held = lambda p: F.try_variant_get("__held", f"${p}" if p.startswith("[") else f"$.{p}", "string")
    plain = lambda p: F.when(~F.coalesce(held(p), F.lit("")).startswith("{"), F.nullif(held(p), F.lit("")))
    got = {name: F.coalesce(*map(plain, paths)) for name, paths in LOG_FIELDS.items()}
    behind = [F.concat(F.lit(f"{name}="), got[name]) for name in ("user", "ip")]
    got["message"] = F.concat_ws(" ", F.nullif(F.trim(got["message"]), F.lit("")), *behind)
    got["level"] = F.upper(F.coalesce(got["level"], F.lit("INFO")))
    return lines.select(*raw.columns, *[c.alias(name) for name, c in got.items()])


def span_files(spark: SparkSession, path: str) -> DataFrame:
    """Spans of all JSON files below ``path``: a list of spans, or an object that holds one; other files are passed over."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    span = "traceId:string,spanId:string,name:string,service:string,startTime:double"
    array = f"array<struct<{span}>>"
    listed, held = F.from_json("value", array), F.from_json("value", f"struct<spans:{array}>")["spans"]
    whole = F.when(F.trim("value").startswith("["), listed).otherwise(held)
    return files.select(F.explode(whole).alias("s")).where("s.traceId IS NOT NULL").select(F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), "s.name", "s.service", F.col("s.startTime").alias("start_s"))


# Folders of foreign code.
FOREIGN = r"(^|/)(node_modules|\.git|vendor|__pycache__|\.venv)/"


def code_files(spark: SparkSession, path: str, suffixes: str = "py,java,js,ts,sql") -> DataFrame:
    """(path, text) of source files below ``path``, foreign code aside."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + suffixes + "}").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(FOREIGN))


def specs(spark: SparkSession, path: str) -> DataFrame:
    """(spec, text) of the JSON documents below ``path``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("spec"), F.col("value").alias("text"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, id, properties) and edges (file, src, dst, properties) of GraphML files; a file is one task's work."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{graphml,xml}").text(path, wholetext=True)
    named = files.select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    elements = F.pandas_udf(_graphml_elements, "array<struct<id:string,src:string,dst:string,properties:map<string,string>>>")
    found = named.select("file", F.explode(elements("text")).alias("e")).select("file", "e.*")
    return found.where("src IS NULL").select("file", "id", "properties"), found.where("src IS NOT NULL").select("file", "src", "dst", "properties")


def _graphml_elements(texts: pd.Series) -> pd.Series:
    def of(text: str) -> list[dict]:
        try:
            root = ElementTree.fromstring(text)
        except ElementTree.ParseError:
            return []
        kind = lambda e: e.tag.rpartition("}")[2]
        names = {k.get("id"): k.get("attr.name") or k.get("id") for k in root.iter() if kind(k) == "key"}
        return [
            {"id": e.get("id"), "src": e.get("source"), "dst": e.get("target"), "properties": {names.get(d.get("key"), d.get("key")): d.text or "" for d in e if kind(d) == "data"}}
            for e in root.iter()
            if kind(e) in ("node", "edge")
        ]

    return texts.map(of)


def presets(folders: list[str], suffix: str = ".json") -> dict[str, str]:
    """Preset files by name, of the first folder that has each."""
    found: dict[str, str] = {}
    for folder in folders:
        for file in sorted(Path(folder).glob(f"*{suffix}")):
            found.setdefault(file.stem, str(file))
    return found


def json_lines(raw: DataFrame, column: str, fields: dict[str, list[str]]) -> DataFrame:
    """Each field is the first of its paths that holds a text which isn't empty."""
    got = {name: F.coalesce(*[F.nullif(F.get_json_object(column, f"$.{p}"), F.lit("")) for p in paths]) for name, paths in fields.items()}
    return raw.select("*", *[c.alias(name) for name, c in got.items()])


OTLP = (
    "struct<resourceSpans:array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>,"
    "scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,name:string,startTimeUnixNano:string>>>>>>>"
)


def otlp_spans(raw: DataFrame, column: str) -> DataFrame:
    """(trace_id, span_id, name, service, start_nano) of every span in OTLP JSON."""
    resources = raw.select(F.explode(F.from_json(column, OTLP)["resourceSpans"]).alias("r"))
    service = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    scopes = resources.select(F.try_element_at(service, F.lit(1))["value"]["stringValue"].alias("service"), F.explode("r.scopeSpans").alias("s"))
    spans = scopes.select("service", F.explode("s.spans").alias("p"))
    return spans.select(F.col("p.traceId").alias("trace_id"), F.col("p.spanId").alias("span_id"), F.col("p.name").alias("name"), F.coalesce("service", F.lit("unknown")).alias("service"), F.col("p.startTimeUnixNano").cast("long").alias("start_nano"))


def otlp_logs(raw: DataFrame, column: str) -> DataFrame:
    """(service, severity, body, trace_id) of every log record in OTLP JSON."""
    record = "struct<severityText:string,traceId:string,body:struct<stringValue:string>>"
    kind = f"struct<resourceLogs:array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>,scopeLogs:array<struct<logRecords:array<{record}>>>>>>"
    resources = raw.select(F.explode(F.from_json(column, kind)["resourceLogs"]).alias("r"))
    service = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    scopes = resources.select(F.try_element_at(service, F.lit(1))["value"]["stringValue"].alias("service"), F.explode("r.scopeLogs").alias("s"))
    return scopes.select("service", F.explode("s.logRecords").alias("l")).select(F.coalesce("service", F.lit("unknown")).alias("service"), F.col("l.severityText").alias("severity"), F.col("l.body.stringValue").alias("body"), F.col("l.traceId").alias("trace_id"))
