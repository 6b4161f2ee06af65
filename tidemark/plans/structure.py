"""Queries over graphs, catalogs, pages and line structure, beside those of ``queries``, in the same registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import sources, streaming
from tidemark.functions.nested import json_leaves
from tidemark.operators import documents, graph, html, logs, search
from tidemark.plans.queries import EDGES, FOREIGN_KEYS, KEYS_SQL, QUERIES, RECORDS, SHARES, SQL, STACKED, edges, incidents_sql, query, records, stacked, transitions

__all__ = ["QUERIES", "SQL"]

# Graphs

CALLS = f"SELECT DISTINCT src, dst FROM ({EDGES}) WHERE relation <> 'IMPORTS'"


@query(f"WITH RECURSIVE e AS ({CALLS}), w AS (SELECT DISTINCT concat('o', o_orderkey) AS seed, concat('o', o_orderkey) AS node FROM orders WHERE o_orderstatus = 'P' UNION SELECT w.seed, e.src FROM w JOIN e ON e.dst = w.node) SELECT node, count(*) AS n_seeds FROM w WHERE node <> seed GROUP BY node")
def graph_ancestors(spark, folder):
    """What leads to the pending orders, and to how many of them."""
    seeds = sources.table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.ancestors(edges(spark, folder).where("relation <> 'IMPORTS'"), seeds).groupBy("node").agg(F.count("*").alias("n_seeds"))


@query(f"WITH RECURSIVE e AS ({CALLS}), w AS (SELECT DISTINCT concat('n', n_nationkey) AS node FROM nation WHERE n_regionkey < 2 UNION SELECT e.dst FROM w JOIN e ON e.src = w.node) SELECT substr(node, 1, 1) AS kind, count(*) AS n FROM w GROUP BY ALL")
def graph_multi_impact(spark, folder):
    seeds = sources.table(spark, folder, "nation").where("n_regionkey < 2").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.impact(edges(spark, folder).where("relation <> 'IMPORTS'"), seeds).groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM ({EDGES}) UNION ALL SELECT dst, src FROM ({EDGES}))), a0 AS (SELECT 'r0' AS node),
    a1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 'r0' AND dst <> 'r0' ORDER BY 1 LIMIT 39),
    a2 AS (SELECT DISTINCT dst AS node FROM b JOIN a1 ON src = node WHERE dst NOT IN (SELECT node FROM a1 UNION ALL SELECT node FROM a0) ORDER BY 1 LIMIT 39 - (SELECT count(*) FROM a1))
    SELECT node, 0 AS depth FROM a0 UNION ALL SELECT node, 1 FROM a1 UNION ALL SELECT node, 2 FROM a2"""
)
def graph_neighbourhood(spark, folder):
    return graph.neighbourhood(edges(spark, folder), "r0", 2, 40)


SUPPLY = "SELECT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst FROM lineitem"


def _propagated(rounds: int) -> str:
    steps = ["l0 AS (SELECT DISTINCT src AS node, src AS community FROM b)"]
    for k in range(rounds):
        votes = f"SELECT src, community, row_number() OVER (PARTITION BY src ORDER BY sum(w) DESC, community) AS place FROM k JOIN l{k} ON dst = node GROUP BY src, community"
        steps.append(f"l{k + 1} AS (SELECT src AS node, community FROM ({votes}) WHERE place = 1)")
    both = f"b AS (SELECT src, dst FROM ({SUPPLY}) UNION ALL SELECT dst, src FROM ({SUPPLY}))"
    links = "k AS (SELECT src, dst, count(*) AS w FROM b GROUP BY ALL UNION ALL SELECT DISTINCT src, src, 1 FROM b)"
    return f"WITH {both}, {links}, {', '.join(steps)} SELECT node, community FROM l{rounds}"


@query(_propagated(4))
def graph_communities(spark, folder):
    items = sources.table(spark, folder, "lineitem")
    return graph.communities(items.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")))


TEAMS = f"SELECT DISTINCT src AS node, ascii(substr(src, 1, 1)) % 3 AS community FROM ({EDGES}) UNION SELECT DISTINCT dst, ascii(substr(dst, 1, 1)) % 3 FROM ({EDGES})"


@query(f"SELECT a.community, count(*) AS n, count(*) FILTER (relation = 'CALLS') AS n_calls, count(*) FILTER (relation = 'IMPORTS') AS n_imports, round(count(*) FILTER (relation = 'CALLS') / count(*), 6) AS calls_share FROM ({EDGES}) e JOIN ({TEAMS}) a ON a.node = src JOIN ({TEAMS}) b ON b.node = dst WHERE a.community = b.community GROUP BY ALL")
def graph_community_stats(spark, folder):
    links = edges(spark, folder)
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    return graph.community_stats(links, nodes.withColumn("community", F.ascii(F.substring("node", 1, 1)) % 3))


@query(
    f"""WITH RECURSIVE e AS (SELECT src, dst, n, round(probability, 6) AS p FROM ({SHARES})),
    w AS (SELECT ['view'] AS nodes, 0.0::DOUBLE AS log_p, 0::HUGEINT AS score UNION ALL SELECT list_append(w.nodes, e.dst), w.log_p + ln(greatest(least(e.p, 1.0), 1e-12)), w.score + e.n FROM w JOIN e ON e.src = w.nodes[-1] WHERE NOT list_contains(w.nodes, e.dst) AND w.nodes[-1] <> 'error' AND len(w.nodes) <= 4)
    SELECT array_to_string(nodes, '>') AS path, round(exp(log_p), 6) AS probability, CAST(score AS BIGINT) AS score FROM w WHERE nodes[-1] = 'error' ORDER BY score DESC, path LIMIT 10"""
)
def graph_hot_paths(spark, folder):
    return graph.hot_paths(graph.paths(graph.edge_shares(transitions(spark, folder)), "view", "error", 4))


SEGMENTS = "SELECT split_part(url, '://', 1) AS scheme, string_split(url, '/') AS parts FROM pages"


@query(f"WITH g AS (SELECT scheme, min(parts) AS low, max(parts) AS high, count(*) AS n FROM ({SEGMENTS}) GROUP BY scheme) SELECT scheme, array_to_string(low[1:list_max(list_filter(range(0, least(len(low), len(high)) + 1), lambda k: low[1:k] = high[1:k]))], '/') AS prefix, n FROM g")
def graph_common_prefix(spark, folder):
    pages = sources.table(spark, folder, "pages").select(F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"), "url")
    return graph.common_prefix(pages, "scheme", "url")


ENDPOINTS = "SELECT concat('/', event_type, '/', user_id % 10) AS endpoint, event_type, event_id % 29 AS ref FROM events"


@query(f"SELECT DISTINCT a.endpoint AS src, b.endpoint AS dst FROM ({ENDPOINTS}) a JOIN ({ENDPOINTS}) b USING (ref) WHERE a.event_type IN ('view', 'click') AND b.event_type NOT IN ('view', 'click') AND a.endpoint <> b.endpoint")
def graph_shared_references(spark, folder):
    """Endpoints whose answers hold what others ask for; the numbers of events stand in for types."""
    events = sources.table(spark, folder, "events").selectExpr("concat('/', event_type, '/', user_id % 10) AS endpoint", "event_type IN ('view', 'click') AS answers", "event_id % 29 AS ref")
    held = events.groupBy("endpoint").agg(F.collect_set(F.when(F.col("answers"), F.col("ref"))).alias("responses"), F.collect_set(F.when(~F.col("answers"), F.col("ref"))).alias("requests"))
    return graph.shared_references(held)


@query(f"SELECT DISTINCT concat('  ', src, ' -->|', relation, '| ', dst) AS line FROM ({EDGES}) WHERE relation = 'CONTAINS'")
def graph_mermaid(spark, folder):
    return graph.mermaid_lines(edges(spark, folder).where("relation = 'CONTAINS'"))


# Catalog

CATALOG = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query(f"SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS place FROM information_schema.columns WHERE table_name IN {CATALOG}")
def catalog_columns(spark, folder):
    """The columns of each table, from the files' own schemas."""
    found = [(name, field, k + 1) for name in CATALOG for k, field in enumerate(sources.table(spark, folder, name).columns)]
    return spark.createDataFrame(found, "table_name string, column_name string, place int")


# Table to schema, as the star schema has no names of schemas of its own.
SCHEMAS = [("region", "geo"), ("nation", "geo"), ("customer", "sales"), ("orders", "sales"), ("lineitem", "sales"), ("part", "supply"), ("supplier", "supply")]
SCHEMAS_SQL = "SELECT * FROM (VALUES " + ", ".join(map(str, SCHEMAS)) + ") AS s(node, community)"


@query(f"SELECT a.community AS schema_name, src, dst FROM ({KEYS_SQL}) k JOIN ({SCHEMAS_SQL}) a ON a.node = src JOIN ({SCHEMAS_SQL}) b ON b.node = dst WHERE a.community = b.community")
def catalog_per_schema(spark, folder):
    """Foreign keys that stay inside a schema."""
    keys = spark.createDataFrame([(a, b) for a, _, b in FOREIGN_KEYS], "src string, dst string")
    names = spark.createDataFrame(SCHEMAS, "node string, community string")
    a, b = names.select(F.col("node").alias("src"), F.col("community").alias("schema_name")), names.select(F.col("node").alias("dst"), F.col("community").alias("other"))
    return keys.join(a, "src").join(b, "dst").where("schema_name = other").select("schema_name", "src", "dst")


# Logs and telemetry

INCIDENTS = incidents_sql(STACKED, False)


@query(
    f"""WITH r AS ({RECORDS}), s AS (SELECT *, row_number() OVER (PARTITION BY logger ORDER BY ts NULLS LAST, file, line) AS place FROM r), t AS (SELECT * FROM r ORDER BY ts NULLS LAST, file, line LIMIT 200)
    SELECT 'incident' AS kind, incident_id AS key, n, concat(title, chr(10), messages) AS text FROM ({INCIDENTS})
    UNION ALL SELECT 'service', coalesce(logger, 'unknown'), count(*), string_agg(message, chr(10) ORDER BY place) FROM s WHERE place <= 30 GROUP BY 2
    UNION ALL SELECT 'timeline', 'all', count(*), string_agg(message, chr(10) ORDER BY ts NULLS LAST, file, line) FROM t"""
)
def log_chunks(spark, folder):
    return logs.chunks(stacked(spark, folder))


@query(f"SELECT 'log' AS source, concat(file, ':', line) AS event_id, logger AS service, level AS severity, message AS body FROM ({RECORDS}) UNION ALL SELECT 'span', CAST(event_id AS VARCHAR), concat('svc-', user_id % 5), 'INFO', event_type FROM events")
def log_telemetry(spark, folder):
    return logs.telemetry(records(spark, folder), QUERIES["otlp_spans"](spark, folder))


@query(f"WITH k AS (SELECT level, file, line, row_number() OVER (PARTITION BY level ORDER BY ts NULLS LAST, file, line) AS place FROM ({RECORDS})) SELECT level, file, line, CAST(place AS INTEGER) AS place FROM k WHERE place <= 20")
def log_first_of_level(spark, folder):
    return logs.first_of_each(records(spark, folder), "level", 20).select("level", "file", "line", "place")


@query("WITH g AS (SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 1800000000, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, session")
def stream_sessions(spark, folder):
    """Sessions of a user's events, run over all files that are there."""
    return streaming.drained(streaming.sessions(streaming.event_stream(spark, folder)), "stream-sessions")


# Documents and pages


@query("""WITH t AS (SELECT conv_id, turn, to_json({'conv': conv_id, 'who': {'role': role, 'empty': []}, 'tags': [turn, turn + 1], 'last': NULL, 'text': text}) AS j FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, replace(replace(fullkey, '$.', ''), '"', '') AS path, CASE WHEN type = 'NULL' THEN 'null' WHEN type = 'ARRAY' THEN '[]' ELSE value ->> '$' END AS value FROM t, json_tree(t.j) WHERE type NOT IN ('OBJECT', 'ARRAY') OR fullkey LIKE '%empty%'""")
def json_flatten(spark, folder):
    """Nested JSON as paths and values."""
    turns = sources.table(spark, folder, "conversations").where("text IS NOT NULL")
    who = F.struct(F.col("role"), F.array().cast("array<string>").alias("empty"))
    value = F.struct(F.col("conv_id").alias("conv"), who.alias("who"), F.array(F.col("turn"), F.col("turn") + 1).alias("tags"), F.lit(None).cast("string").alias("last"), "text")
    found = turns.select("conv_id", "turn", F.explode(json_leaves(F.to_json(value, {"ignoreNullFields": "false"}))).alias("leaf"))
    return found.select("conv_id", "turn", "leaf.path", "leaf.value")


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(f"SELECT p.page_id, CASE WHEN regexp_matches(link, '^[a-z]+://') THEN link WHEN starts_with(link, '/') THEN concat(split_part(url, '://', 1), '://', {HOST}, link) ELSE concat(split_part(url, '://', 1), '://', {HOST}, '/', link) END AS link, NOT regexp_matches(link, '^[a-z]+://') AS inside FROM ({SQL['page_links']}) l JOIN pages p USING (page_id)")
def page_same_site(spark, folder):
    return html.links(sources.table(spark, folder, "pages")).select("page_id", "link", "inside")


@query(f"SELECT link, count(DISTINCT page_id) AS n, min(page_id) AS first, max(page_id) AS last FROM ({SQL['page_links']}) GROUP BY link")
def page_backlinks(spark, folder):
    return documents.backlinks(documents.links(sources.table(spark, folder, "pages")))


@query("WITH c AS (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS found FROM pages) SELECT page_id, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS place, trim(regexp_replace(unnest(found), '<[^>]*>', '', 'g')) AS cell FROM c")
def page_items(spark, folder):
    return documents.table_cells(sources.table(spark, folder, "pages"))


LINES = "SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)"


@query(f"SELECT CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(text, '{documents.BULLET}') THEN 'bullet' WHEN regexp_matches(text, '{documents.NUMBERED}') THEN 'numbered' WHEN regexp_matches(text, '{documents.CAPITALS}') THEN 'heading' WHEN regexp_matches(text, '{documents.KEY_VALUE}') THEN 'pair' ELSE 'text' END AS kind, count(*) AS n FROM ({LINES}) GROUP BY kind")
def text_line_kinds(spark, folder):
    return documents.line_kinds(sources.table(spark, folder, "documents"))


@query(f"WITH p AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM ({LINES}) WHERE regexp_matches(text, '{documents.KEY_VALUE}')) SELECT doc_id, CAST(min(line) AS INTEGER) AS first_line, count(*) AS n FROM p GROUP BY doc_id, run")
def text_pair_runs(spark, folder):
    return documents.pair_runs(sources.table(spark, folder, "documents"))


@query("SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY digest")
def text_distinct_contents(spark, folder):
    return documents.distinct_contents(sources.table(spark, folder, "documents"))


@query("SELECT conv_id, turn, format('{:d}:{:02d}:{:02d}.{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS started FROM (SELECT conv_id, turn, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 61 AS ms FROM conversations)")
def conversation_clock(spark, folder):
    """When each turn starts, if reading a character takes 61 ms."""
    before = F.sum(F.length(F.coalesce("text", F.lit("")))).over(documents.Window.partitionBy("conv_id").orderBy("turn").rowsBetween(documents.Window.unboundedPreceding, -1))
    return sources.table(spark, folder, "conversations").withColumn("ms", F.coalesce(before, F.lit(0)) * 61).select("conv_id", "turn", documents.clock(F.col("ms")).alias("started"))


@query("SELECT item_id AS id, 0.5::DOUBLE AS score FROM benchmark WHERE contains(lower(text), 'and')")
def search_substring(spark, folder):
    return search.substring_hits(sources.table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text"), "AND")


@query("SELECT item_id, list_transform(range(0, 64), lambda k: (CAST(concat('0x', substr(sha256(text), CAST(k % 32 * 2 + 1 AS BIGINT), 2)) AS INTEGER) - 128) / 128) AS vector FROM benchmark")
def search_hash_vectors(spark, folder):
    return sources.table(spark, folder, "benchmark").select("item_id", search.hash_vector(F.col("text")).alias("vector"))
