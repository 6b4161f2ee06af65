"""More queries over records: levels, ids, requests, times, JSON lines, order and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import sinks, sources
from tidemark.functions import text as fn
from tidemark.operators import learning, logs, tables
from tidemark.plans.queries import QUERIES, RECORDS, SQL, STACKED, incidents_sql, query, records, stacked

__all__ = ["QUERIES", "SQL"]

IDS = "concat(message, CASE line % 4 WHEN 0 THEN concat(' request_id=r', line % 53) WHEN 1 THEN concat(' correlation-id: c', line % 31) ELSE '' END, CASE WHEN line % 3 = 0 THEN concat(' sessionId=s', line % 7, ' spanId=p', line % 11) ELSE '' END)"
WITH_IDS = f"SELECT * REPLACE ({IDS} AS message) FROM ({RECORDS})"


def with_ids(spark, folder):
    return records(spark, folder).withColumn("message", F.expr(IDS))


def _found(pattern: str, text: str = "message") -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"


NOISY = "concat(CASE line % 6 WHEN 0 THEN 'a Warning: ' WHEN 1 THEN '[error] ' WHEN 2 THEN 'information ' WHEN 3 THEN ' debug - ' ELSE '' END, event_type, ' info ', line)"
LEVELS = f"upper({_found(fn.LEVEL_WORD, 't')})"


@query(f"SELECT line, CASE WHEN {LEVELS} = 'WARNING' THEN 'WARN' ELSE {LEVELS} END AS level, regexp_replace(regexp_replace(t, '(?is)^(.*?)\\b(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\\b', '\\1'), '^\\s+|\\s+$', '', 'g') AS rest FROM (SELECT line, {NOISY} AS t FROM ({RECORDS}))")
def log_level_scan(spark, folder):
    texts = records(spark, folder).select("line", F.expr(NOISY).alias("t"))
    return texts.select("line", fn.scan_level(F.col("t")).alias("level"), fn.without_level(F.col("t")).alias("rest"))


TRACES = "CASE line % 9 WHEN 0 THEN '  at a.B.c(D.java:1)' WHEN 1 THEN 'Caused by: x' WHEN 2 THEN 'java.lang.Thread.run' WHEN 3 THEN 'a sun.reflect.X y' WHEN 4 THEN ' my.BadException: no' WHEN 5 THEN '... 12 more' WHEN 6 THEN '   ' WHEN 7 THEN 'at noon' ELSE message END"


@query(f"SELECT line, trim(t) <> '' AND ({' OR '.join(f"regexp_matches(t, '{p}')" for p in fn.STACK_LINES)}) AS is_stack FROM (SELECT line, {TRACES} AS t FROM ({RECORDS}))")
def log_stack_lines(spark, folder):
    return records(spark, folder).select("line", fn.is_stack_line(F.expr(TRACES)).alias("is_stack"))


@query(f"SELECT line, coalesce({', '.join(_found(p) for p in fn.CORRELATION_IDS)}) AS correlation_id, {_found(fn.FIELD.format(head='session', tail='id'))} AS session_id FROM ({WITH_IDS})")
def log_correlation_ids(spark, folder):
    return with_ids(spark, folder).select("line", fn.correlation_id(F.col("message")).alias("correlation_id"), fn.field(F.col("message"), "session_id").alias("session_id"))


REQ, CORR, SESS, SPAN, TRACE = (_found(fn.FIELD.format(head=h, tail="id")) for h in ("request", "correlation", "session", "span", "trace"))


@query(
    f"""WITH r AS ({WITH_IDS}), k AS (SELECT *, coalesce({REQ}, {CORR}, {', '.join(_found(p) for p in fn.CORRELATION_IDS)}) AS request_id, {CORR} AS cid, {SESS} AS sid FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY line) AS place FROM k WHERE request_id IS NOT NULL)
    SELECT request_id, max(CASE WHEN place = 1 THEN cid END) AS correlation_id, max(CASE WHEN place = 1 THEN sid END) AS session_id, count(*) AS n, min(line) AS first_line, max(line) AS last_line,
    string_agg(line, ',' ORDER BY line) FILTER (place <= 20) AS lines FROM p GROUP BY request_id"""
)
def log_requests(spark, folder):
    """Records by request, or else by correlation."""
    return logs.requests(with_ids(spark, folder))


@query(f"SELECT trace_id, arg_max_null(span, line) AS span_id, count(*) AS n FROM (SELECT line, {TRACE} AS trace_id, {SPAN} AS span FROM ({WITH_IDS})) WHERE trace_id IS NOT NULL GROUP BY trace_id")
def log_trace_links(spark, folder):
    """Traces with the last span that their records name."""
    rows = with_ids(spark, folder)
    return logs.trace_links(rows).select("trace_id", "span_id", "n")


STAMPS = "CASE event_id % 4 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 2 THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss') ELSE 'no time' END"


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def log_timestamps(spark, folder):
    """Times in several formats, read back; what is no time is null."""
    events = sources.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", F.date_format(fn.parse_timestamp(F.expr(STAMPS)), "yyyy-MM-dd HH:mm:ss").alias("at"))


JSON_LINE = """CASE event_id % 4 WHEN 0 THEN concat('{"severity":"', event_type, '","msg":"m', event_id, '","@timestamp":"t","username":"u', user_id, '"}')
WHEN 1 THEN concat('{"log":{"level":"warn","message":" x "},"time":"t","fields":{"ip":"10.0.0.', user_id % 9, '"}}') WHEN 2 THEN concat('{"message":"","body":"b', event_id, '","user":{"name":"n', user_id, '"},"threadName":"w"}') ELSE concat('not json ', event_id) END"""


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN 'WARN' ELSE 'INFO' END AS level, CASE event_id % 4 WHEN 0 THEN concat('m', event_id, ' user=u', user_id) WHEN 1 THEN concat('x ip=10.0.0.', user_id % 9) ELSE concat('b', event_id, ' user=n', user_id) END AS message,
    CASE WHEN event_id % 4 < 2 THEN 't' END AS ts_text, CASE WHEN event_id % 4 = 2 THEN 'w' END AS thread FROM events WHERE event_id % 4 < 3"""
)
def log_json_fields(spark, folder):
    """JSON lines by any of the usual names of their fields."""
    raw = sources.table(spark, folder, "events").select("event_id", F.expr(JSON_LINE).alias("raw"))
    return sources.json_log(raw, "raw").select("event_id", "level", "message", "ts_text", "thread")


@query(f"SELECT logger, count(*) FILTER (regexp_matches(lower(message), 'timeout|pool')) AS n FROM ({RECORDS}) GROUP BY logger HAVING n >= 3")
def log_keyword_alarms(spark, folder):
    return logs.keyword_alarms(records(spark, folder), ("timeout", "pool"))


@query(f"WITH f AS (SELECT file, count(*) AS n, sum(length(message))::BIGINT AS n_chars, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS seconds FROM ({RECORDS}) GROUP BY file) SELECT *, round(n / greatest(seconds, 1), 6) AS per_second FROM f")
def log_throughput(spark, folder):
    return logs.throughput(records(spark, folder))


@query(f"SELECT level, line, printf('%04d', row_number() OVER (PARTITION BY level ORDER BY ts NULLS LAST, file, line)) AS seq FROM ({RECORDS})")
def log_numbered(spark, folder):
    """Records with a number inside their level."""
    return logs.numbered(records(spark, folder), "level", ["ts", "file", "line"]).select("level", "line", "seq")


@query(f"WITH f AS (SELECT level, logger, min(line) AS moment FROM ({RECORDS}) GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY level ORDER BY moment, logger) AS INTEGER) AS place FROM f) SELECT level, logger, place FROM k WHERE place <= 3")
def log_first_services(spark, folder):
    return logs.first_distinct(records(spark, folder), "level", "logger", "line", 3)


@query(f"SELECT * FROM ({incidents_sql(STACKED, True)}) ORDER BY severity DESC, incident_id LIMIT 500")
def log_incident_order(spark, folder):
    """The gravest incidents first."""
    return QUERIES["log_incidents"](spark, folder).orderBy(F.desc("severity"), "incident_id").limit(500)


@query(f"SELECT concat('incident-', incident_id, '.md') AS name, concat('---', chr(10), 'incident_id: ', incident_id, chr(10), 'occurrences: ', n, chr(10), 'severity: ', severity, chr(10), '---', chr(10), chr(10), '# ', title, chr(10), chr(10), '- ', replace(messages, chr(10), concat(chr(10), '- '))) AS text FROM ({incidents_sql(STACKED, False)}) ORDER BY severity DESC, incident_id LIMIT 500")
def log_incident_documents(spark, folder):
    return logs.incident_documents(logs.incidents(stacked(spark, folder)))


@query(f"SELECT substr(sha256(stacktrace), 1, 16) AS key, count(*) AS n, substr(stacktrace, 1, 4000) AS text FROM ({STACKED}) WHERE stacktrace <> '' GROUP BY stacktrace")
def log_stack_chunks(spark, folder):
    return logs.stack_chunks(stacked(spark, folder))


@query(f"SELECT line, trace_id, span_id, score FROM ({SQL['log_span_links']}) ORDER BY score DESC, line, span_id LIMIT 100")
def log_cross_source(spark, folder):
    """The best hundred links of records and spans."""
    return logs.cross_source(QUERIES["log_span_links"](spark, folder))


@query(
    f"""WITH r AS ({RECORDS}), c AS (SELECT level, count(*) AS n FROM r GROUP BY level), k AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY line, file) AS place FROM r)
    SELECT 'summary.md' AS name, concat('# Levels', chr(10), chr(10), string_agg(concat('- ', level, ': ', n), chr(10) ORDER BY n DESC, level)) AS text FROM c
    UNION ALL SELECT concat('raw/', lower(level), '.md'), concat('# ', level, chr(10), chr(10), string_agg(concat('- ', message), chr(10) ORDER BY place) FILTER (place <= 5000), CASE WHEN count(*) > 5000 THEN concat(chr(10), chr(10), count(*) - 5000, ' more') ELSE '' END) FROM k GROUP BY level"""
)
def log_markdown_tree(spark, folder):
    """Documents of a report: the counts, and the first records of each level."""
    return sinks.markdown_tree(records(spark, folder), cap=5000)


@query("SELECT user_id, event_type AS kind, substr(props, 1, 4) AS detail, min(event_id) AS first_event FROM events GROUP BY ALL")
def rows_first_by_detail(spark, folder):
    """One row of each kind and head of the detail."""
    rules = sources.table(spark, folder, "events").select("user_id", F.col("event_type").alias("kind"), F.col("props").alias("detail"), F.col("event_id").alias("first_event"))
    return tables.first_by_detail(rules, ["user_id", "kind"], "detail", "first_event", size=4).select("user_id", "kind", F.substring("detail", 1, 4).alias("detail"), "first_event")


@query(f"SELECT 'log' AS source, line AS id, message AS body, NULL::VARCHAR AS role FROM ({RECORDS}) UNION ALL SELECT 'chat', conv_id, text, role FROM conversations")
def rows_all_sources(spark, folder):
    """Records and turns as one table."""
    log = records(spark, folder).select(F.col("line").alias("id"), F.col("message").alias("body"))
    chat = sources.table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("body"), "role")
    return tables.all_sources({"log": log, "chat": chat}).select("source", "id", "body", "role")


@query("SELECT event_id, event_type, 'run-1' AS lineage_run, 'events' AS lineage_source, 30 AS retention_days FROM events")
def rows_lineage(spark, folder):
    return tables.with_lineage(sources.table(spark, folder, "events").select("event_id", "event_type"), "run-1", "events", 30)


@query("SELECT item_id, concat('{\"kind\":\"item\",\"id\":\"', item_id, '\",\"tags\":[\"a\",\"b\"],\"body\":\"', length(text), '\"}') AS artifact, true AS valid FROM benchmark")
def artifact_round_trip(spark, folder):
    """Artifacts as JSON, and whether they hold what they must."""
    items = sources.table(spark, folder, "benchmark")
    made = items.select("item_id", sinks.artifact_json(F.lit("item"), F.col("item_id").cast("string"), F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.length("text").cast("string")).alias("artifact"))
    return made.withColumn("valid", sinks.valid_artifact(F.col("artifact")))


@query()
def cluster_members(spark, folder):
    """Sizes and first members of eight clusters of all vectors."""
    return learning.cluster_members(learning.k_means(sources.table(spark, folder, "embeddings")), "vec_id")


@query()
def cluster_texts(spark, folder):
    """Clusters of all texts by the weights of their terms."""
    weighted = learning.tf_idf(sources.table(spark, folder, "documents").select("doc_id", "text"), size=1024)
    return learning.k_means(weighted.select("doc_id", "features"), "features", k=4).select("doc_id", "cluster")
