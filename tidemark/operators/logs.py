"""Log records: sessions of lines, noise, incidents, correlation and counts.

Records have level, logger, message, file, line and, where known, ts and stacktrace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as fn

# Shapes of structured lines, as (pattern, group of the time, level, logger, message).
LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) ([A-Z]+) \[([^\]]*)\] (.*)$"
LOGBACK = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)[.,]\d{3} \[[^\]]*\] ([A-Z]+)\s+(\S+) - (.*)$"
FAILURES = ("ERROR", "FATAL")


def structured(text: Column, patterns: tuple[str, ...], group: int) -> Column:
    """A group of the first pattern that fits, empty if none does."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, group)) for p in patterns], F.lit(""))


def _opened(lines: DataFrame, patterns: tuple[str, ...], block: int) -> DataFrame:
    """``lines`` with opens, and record, the line that opened the record that a line belongs to.

    A file is cut into blocks of ``block`` lines, each with a window of its own; a block's first lines
    take the last opening line of the blocks before, of which there is one number a block.
    """
    opens = structured(F.col("text"), patterns, 2) != ""
    marked = lines.withColumn("opens", opens).withColumn("block", F.floor(F.col("line") / block))
    start = F.when(F.col("opens"), F.col("line"))
    blocks = marked.groupBy("file", "block").agg(F.max(start).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("own", F.max(start).over(inside)).join(carried, ["file", "block"]).withColumn("record", F.coalesce("own", "carried")).drop("own", "carried", "block")


def malformed(lines: DataFrame, patterns: tuple[str, ...] = (LINE, LOGBACK), block: int = 100_000) -> DataFrame:
    """(file, n) of the lines before the first structured one of a file, blank ones aside."""
    lost = _opened(lines, patterns, block).where("record IS NULL AND trim(text) <> ''")
    return lost.groupBy("file").agg(F.count("*").alias("n"))


def sessionize(lines: DataFrame, patterns: tuple[str, ...] = (LINE, LOGBACK), block: int = 100_000) -> DataFrame:
    """Records from (file, line, text): a structured line opens one, stack lines and others join the open one.

    Lines before the first structured line of a file belong to no record; ``malformed`` counts them.
    """
    marked = _opened(lines, patterns, block).where("record IS NOT NULL")
    part = F.struct("line", "text")
    stack = F.array_sort(F.collect_list(F.when(~F.col("opens") & fn.is_stack_line(F.col("text")), part)))
    rest = F.array_sort(F.collect_list(F.when(~F.col("opens") & ~fn.is_stack_line(F.col("text")), part)))
    whole = marked.groupBy("file", "record").agg(F.min("line").alias("line"), F.min_by("text", "line").alias("head"), stack.alias("stack"), rest.alias("rest"))
    head = [structured(F.col("head"), patterns, k) for k in (1, 2, 3, 4)]
    joined = F.array_join(F.concat(F.array(head[3]), F.transform("rest", lambda x: x["text"])), "\n")
    stacktrace = F.nullif(F.array_join(F.transform("stack", lambda x: x["text"]), "\n"), F.lit(""))
    return whole.select("file", F.col("line").cast("long").alias("line"), head[0].alias("ts_text"), head[1].alias("level"), head[2].alias("logger"), joined.alias("message"), stacktrace.alias("stacktrace"))


def level_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("level").agg(F.count("*").alias("n"))


def top_messages(records: DataFrame, n: int = 30) -> DataFrame:
    """The most frequent failure messages, cut to 500 characters; ties by message."""
    failures = records.where(F.col("level").isin(*FAILURES))
    return failures.groupBy(F.substring("message", 1, 500).alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(n)


def time_buckets(records: DataFrame, unit: str = "hour") -> DataFrame:
    stamp = F.date_format(F.date_trunc(unit, F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    return records.where("ts IS NOT NULL").groupBy(stamp.alias("bucket")).agg(F.count("*").alias("n"))


def error_rate(records: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("level").isin(*FAILURES))
    return records.agg(F.count("*").alias("n_records"), failed.alias("n_errors"), F.round(failed / F.greatest(F.count("*"), F.lit(1)), 6).alias("error_rate"))


def filter_noise(records: DataFrame, least_length: int = 3, least_entropy: float = 0.3) -> DataFrame:
    """Records whose messages are long and varied enough."""
    return records.where((F.length(F.trim("message")) >= least_length) & (fn.char_entropy(F.col("message")) >= least_entropy))


def distinct_messages(records: DataFrame) -> DataFrame:
    """The first record, by file and line, of each level, logger and message.

    The first is found by a minimum, which tasks take before the shuffle, so that a message that fills a
    third of the log doesn't meet in one task.
    """
    key = fn.dedupe_fingerprint(F.col("level"), F.col("logger"), F.col("message"))
    first = F.min(F.struct("file", "line", "level", "logger", "message"))
    return records.groupBy(key.alias("fingerprint")).agg(first.alias("r")).select("fingerprint", "r.*")


def incidents(records: DataFrame, least: int = 2, stacks: bool = False) -> DataFrame:
    """Failures by the hash of the whole normalised message, and of the first stack line if ``stacks``.

    (incident_id, title, n, severity, first_line, last_line, services, cause, messages, stacktraces). The
    title, of 80 characters, is for display only; the cause is scored on the whole message. The first 8
    messages and 5 stack traces, by time, file and line, are distinct; they are found by minima and ranks,
    so that no list of all of a group's texts is held.
    """
    for name, kind in (("ts", "timestamp"), ("stacktrace", "string")):
        records = records if name in records.columns else records.withColumn(name, F.lit(None).cast(kind))
    whole = F.trim(fn.mask_ips(fn.normalize(F.coalesce("message", F.lit("")))))
    head = F.trim(fn.mask_ips(fn.normalize(F.substring_index("stacktrace", "\n", 1))))
    basis = F.concat_ws("|", "whole", F.when(F.col("stacktrace") != "", head)) if stacks else F.col("whole")
    failures = records.where(F.col("level").isin(*FAILURES)).withColumn("whole", whole).withColumn("fp", fn.stable_hash(basis))
    grouped = failures.groupBy("fp").agg(
        F.min("whole").alias("whole"),  # all of a group are equal
        F.count("*").alias("n"),
        F.max(fn.severity_score(F.col("level"))).alias("level_part"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("logger"), F.lit("")))), ",").alias("services"),
    )
    grouped = grouped.where(F.col("n") >= least)
    place = F.struct(F.col("ts").isNull(), "ts", "file", "line")

    def firsts(text: Column, n: int, shown: int, name: str) -> DataFrame:
        order = Window.partitionBy("fp").orderBy("at", "text")
        found = failures.select("fp", text.alias("text"), place.alias("at")).where("text <> ''").groupBy("fp", "text").agg(F.min("at").alias("at"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        told = F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, shown).alias("text"))))
        return best.groupBy("fp").agg(F.transform(told, lambda r: r["text"]).alias(name))

    messages = firsts(F.substring(F.replace(F.col("message"), F.lit("\n"), F.lit(" ")), 1, 500), 8, 500, "messages")
    traces = firsts(F.col("stacktrace"), 5, 4000, "stacktraces")
    title = F.coalesce(F.nullif(F.trim(F.substring(F.replace(F.col("whole"), F.lit("\n"), F.lit(" ")), 1, 80)), F.lit("")), F.lit("unknown"))
    severity = F.round(F.col("level_part") + F.least(F.col("n") * 2.0, F.lit(40.0)), 2)
    none = F.array().cast("array<string>")
    full = grouped.withColumn("title", title).join(messages, "fp", "left").join(traces, "fp", "left")
    return full.select(
        fn.stable_hash(F.concat_ws("|", "fp", "title"), 12).alias("incident_id"), "title", "n", severity.alias("severity"), "first_line", "last_line", "services",
        _cause(F.col("whole"), F.col("n")).alias("cause"), F.coalesce("messages", none).alias("messages"), F.coalesce("stacktraces", none).alias("stacktraces"),
    )


def incidents_by_title(records: DataFrame, least: int = 2) -> DataFrame:
    """A coarser roll-up than ``incidents``: failures that share the first 80 characters of the normalised message.

    Different failures with the same title merge, and the cause is scored on the title only.
    """
    failures = records.where(F.col("level").isin(*FAILURES))
    title = F.coalesce(F.nullif(F.substring(fn.mask_ips(fn.normalize(F.col("message"))), 1, 80), F.lit("")), F.lit("unknown"))
    grouped = failures.withColumn("title", title).groupBy("title").agg(
        F.count("*").alias("n"),
        F.max(fn.severity_score(F.col("level"))).alias("level_part"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.array_join(F.array_sort(F.collect_set("logger")), ",").alias("services"),
    )
    severity = F.round(F.col("level_part") + F.least(F.col("n") * 2.0, F.lit(40.0)), 2)
    return grouped.where(F.col("n") >= least).select(fn.stable_hash(F.col("title"), 12).alias("incident_id"), "title", "n", severity.alias("severity"), "first_line", "last_line", "services", _cause(F.col("title"), F.col("n")).alias("cause"))


def _cause(text: Column, n: Column) -> Column:
    points = F.when(text.rlike("(?i)timeout"), 40).otherwise(0) + F.when(text.rlike("(?i)pool|connection"), 30).otherwise(0) + F.when(n >= 3, 10).otherwise(0)
    return F.when(points >= 50, "pool exhaustion").otherwise("dependency")


def correlated(records: DataFrame, name: str = "trace_id") -> DataFrame:
    """Records that share a request or trace: how many, and the first and last line."""
    keyed = records.withColumn("key", fn.field(F.col("message"), name)).where("key IS NOT NULL")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.max_by("logger", "line").alias("last_service"))


def link_spans(records: DataFrame, spans: DataFrame, window_s: int = 300) -> DataFrame:
    """Each record with the first span of its trace, scored by closeness: 0.9, and up to 0.1 more within the window."""
    first = spans.groupBy("trace_id").agg(F.min_by(F.struct("span_id", "start_s"), "span_id").alias("s"))
    keyed = records.withColumn("trace_id", fn.field(F.col("message"), "trace_id"))
    apart = F.abs(F.col("at_s") - F.col("s.start_s"))
    score = 0.9 + F.when(apart <= window_s, 0.1 * (1 - apart / window_s)).otherwise(0.0)
    return keyed.join(first, "trace_id").select("line", "trace_id", F.col("s.span_id").alias("span_id"), F.round(F.least(score, F.lit(1.0)), 6).alias("score"))


def service_counts(records: DataFrame, n: int = 100) -> DataFrame:
    return records.groupBy(F.coalesce("logger", F.lit("unknown")).alias("service")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "service").limit(n)


def capped_by_level(records: DataFrame, cap: int = 5000) -> DataFrame:
    """The first ``cap`` records of each level by line, and the size of the level."""
    order = Window.partitionBy("level").orderBy("line")
    sizes = records.groupBy("level").agg(F.count("*").alias("level_size"))
    first = records.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
    return first.join(F.broadcast(sizes), "level").select("level", "line", "place", "level_size")


def tagged(records: DataFrame) -> DataFrame:
    """Records with the names of the patterns that their messages and stacks match, and the classes that their messages match."""
    text = F.col("message")
    whole = F.concat_ws("\n", "message", "stacktrace") if "stacktrace" in records.columns else text
    return records.select("line", F.array_join(fn.tags(whole, fn.PATTERN_TAGS), ",").alias("tags"), F.array_join(fn.tags(text, fn.CLASSES), ",").alias("classes"), fn.severity_rank(F.col("level")).alias("rank"))


# What names another service in a message.
TARGETS = (r"(?i)\bhttps?://([^\s/]+)", r"(?i)\b(?:redis|kafka|postgres|mysql)://([^\s/]+)", r"(?i)\bconnected to ([a-z0-9._-]+)")


def topology(records: DataFrame) -> DataFrame:
    """(service, target, n) edges from the addresses that messages name."""
    found = F.concat(*[F.regexp_extract_all("message", F.lit(p), F.lit(1)) for p in TARGETS])
    return records.select(F.coalesce("logger", F.lit("app")).alias("service"), F.explode(found).alias("target")).groupBy("service", "target").agg(F.count("*").alias("n"))


def topology_lines(edges: DataFrame) -> DataFrame:
    """(part, line) of a flow chart over (service, target): a line a node, then a line an edge, names cut to 40 characters."""
    name = lambda c: F.substring(F.regexp_replace(c, "[-.]", "_"), 1, 40)
    nodes = edges.select(F.col("service").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    shown = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("    "), name("node"), F.lit("["), F.substring("node", 1, 40), F.lit("]")).alias("line"))
    return shown.unionByName(edges.select(F.lit(1).alias("part"), F.concat(F.lit("    "), name("service"), F.lit(" --> "), name("target")).alias("line")).distinct())


# Words that mark a step of a failure.
CAUSAL = ("timeout", "pool", "exhausted", "refused", "deadlock")


def causal_lines(records: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` records, by time, whose messages hold a causal word."""
    return records.where(F.lower("message").rlike("|".join(CAUSAL))).orderBy(F.asc_nulls_last("ts"), "file", "line").limit(n)


def relations(records: DataFrame) -> DataFrame:
    """(subject, verb, object, n): which services use stores, and publish to topics, by the names in messages."""
    text, parts = F.lower("message"), []
    for name, verb in (("redis", "uses"), ("postgres", "uses"), ("kafka", "publishes")):
        parts.append(F.when(text.rlike(rf"\b{name}"), F.struct(F.lit(verb).alias("verb"), F.lit(name).alias("object"))))
    found = records.select(F.coalesce("logger", F.lit("unknown")).alias("subject"), F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("r"))
    return found.groupBy("subject", "r.verb", "r.object").agg(F.count("*").alias("n"))


def first_of_each(records: DataFrame, group: str, n: int) -> DataFrame:
    """The first ``n`` records of each group by time, file and line, with their place."""
    order = Window.partitionBy(group).orderBy(F.asc_nulls_last("ts"), "file", "line")
    return records.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def chunks(records: DataFrame, service_size: int = 30, timeline_size: int = 200) -> DataFrame:
    """(kind, key, n, text) pieces for retrieval: one an incident, the head of each service, and the head of the whole timeline.

    Sizes bound what a text may hold; every text is in order of time.
    """

    def joined(rows: DataFrame, kind: str, key: Column) -> DataFrame:
        told = F.array_sort(F.collect_list(F.struct("place", "message")))
        return rows.groupBy(F.lit(kind).alias("kind"), key.alias("key")).agg(F.count("*").alias("n"), F.array_join(F.transform(told, lambda r: r["message"]), "\n").alias("text"))

    found = incidents(records).select(F.lit("incident").alias("kind"), F.col("incident_id").alias("key"), "n", F.concat_ws("\n", F.array("title"), "messages").alias("text"))
    service = first_of_each(records.withColumn("service", F.coalesce("logger", F.lit("unknown"))), "service", service_size)
    head = records.orderBy(F.asc_nulls_last("ts"), "file", "line").limit(timeline_size)
    timeline = head.withColumn("place", F.struct(F.col("ts").isNull(), "ts", "file", "line"))
    return found.unionByName(joined(service, "service", F.col("service"))).unionByName(joined(timeline, "timeline", F.lit("all")))


def telemetry(records: DataFrame, spans: DataFrame) -> DataFrame:
    """Records and spans as one table of events: (source, event_id, service, severity, body)."""
    a = records.select(F.lit("log").alias("source"), F.concat_ws(":", "file", "line").alias("event_id"), F.coalesce("logger", F.lit("unknown")).alias("service"), F.col("level").alias("severity"), F.col("message").alias("body"))
    return a.unionByName(spans.select(F.lit("span").alias("source"), F.col("span_id").alias("event_id"), "service", F.lit("INFO").alias("severity"), F.col("name").alias("body")))


def _text(records: DataFrame) -> Column:
    stack = F.coalesce("stacktrace", F.lit("")) if "stacktrace" in records.columns else F.lit("")
    return F.concat(F.coalesce("message", F.lit("")), F.lit(" "), stack)


def requests(records: DataFrame) -> DataFrame:
    """(request_id, correlation_id, session_id, n, first_line, last_line, lines): records that share a request or correlation id.

    The key is the request id of the text, or else the correlation id. The other ids are those of the first
    record; ``lines`` are the first 20 lines, found by rank, so that no list of all is held.
    """
    text = _text(records)
    keyed = records.withColumn("correlation_id", fn.field(text, "correlation_id")).withColumn("session_id", fn.field(text, "session_id"))
    keyed = keyed.withColumn("request_id", F.coalesce(fn.field(text, "request_id"), "correlation_id", fn.correlation_id(F.col("message")))).where("request_id IS NOT NULL")
    found = keyed.groupBy("request_id").agg(F.min_by(F.struct("correlation_id", "session_id"), "line").alias("first"), F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("line"))
    shown = keyed.withColumn("place", place).where("place <= 20").groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list("line")), ",").alias("lines"))
    return found.join(shown, "request_id").select("request_id", "first.correlation_id", "first.session_id", "n", "first_line", "last_line", "lines")


def trace_links(records: DataFrame) -> DataFrame:
    """(trace_id, span_id, n): records by trace, with the last span id that they name."""
    text = _text(records)
    keyed = records.withColumn("trace_id", fn.field(text, "trace_id")).where("trace_id IS NOT NULL").withColumn("span", fn.field(text, "span_id"))
    return keyed.groupBy("trace_id").agg(F.max_by("span", "line").alias("span_id"), F.count("*").alias("n"))


def keyword_alarms(records: DataFrame, words: tuple[str, ...], least: int = 3) -> DataFrame:
    """Services of which at least ``least`` messages hold one of ``words``."""
    held = F.count_if(F.lower("message").rlike("|".join(words)))
    return records.groupBy("logger").agg(held.alias("n")).where(F.col("n") >= least)


def throughput(records: DataFrame) -> DataFrame:
    """(file, n, n_chars, seconds, per_second) of each file: how many records its span of time holds."""
    span = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    found = records.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.length("message")).alias("n_chars"), span.alias("seconds"))
    return found.withColumn("per_second", F.round(F.col("n") / F.greatest("seconds", F.lit(1)), 6))


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "seq") -> DataFrame:
    """``rows`` with a number of four digits or more in each group, by ``order``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn(name, F.format_string("%04d", place))


def first_distinct(rows: DataFrame, group: str, value: str, order: str, n: int) -> DataFrame:
    """(group, value, place): the first ``n`` distinct values of each group in order, found by minima."""
    firsts = rows.groupBy(group, value).agg(F.min(order).alias("at"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("at", value))).where(F.col("place") <= n).select(group, value, "place")


def cross_source(links: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` links of (line, trace_id, span_id, score) that score highest."""
    return links.orderBy(F.desc("score"), "line", "span_id").limit(n)


def stack_chunks(records: DataFrame, clip: int = 4000) -> DataFrame:
    """(key, n, text): distinct stack traces by their hash, each cut to ``clip`` characters for display."""
    traced = records.where("stacktrace <> ''")
    return traced.groupBy(fn.stable_hash(F.col("stacktrace")).alias("key")).agg(F.count("*").alias("n"), F.min(F.substring("stacktrace", 1, clip)).alias("text"))


def incident_documents(found: DataFrame, n: int = 500) -> DataFrame:
    """(name, text): a Markdown document with front matter for each of the ``n`` gravest incidents."""
    best = found.orderBy(F.desc("severity"), "incident_id").limit(n)
    listed = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("- "), m)), "\n")
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("incident_id: "), "incident_id"), F.concat(F.lit("occurrences: "), F.col("n").cast("string")), F.concat(F.lit("severity: "), F.col("severity").cast("string")), F.lit("---"))
    return best.select(F.concat(F.lit("incident-"), "incident_id", F.lit(".md")).alias("name"), F.concat_ws("\n", head, F.lit(""), F.concat(F.lit("# "), "title"), F.lit(""), listed).alias("text"))
