"""Queries over a graph of code: parts of the star schema stand in for symbols, line items for what they call."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import sinks, sources
from tidemark.operators import codegraph, graph
from tidemark.plans.queries import FOREIGN_KEYS, KEYS_SQL, QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


def _path(k: str) -> str:
    return f"concat('src/', CASE {k} % 5 WHEN 0 THEN 'api/v1' WHEN 1 THEN 'test/unit' WHEN 2 THEN 'model/base' WHEN 3 THEN 'order-service/x' ELSE 'core' END, '/f', {k} % 17, '.py')"


def _symbol(k: str) -> str:
    return f"concat({_path(k)}, '::m', {k})"


SYMBOL = {
    "id": _symbol("p_partkey"),
    "kind": "CASE WHEN p_partkey % 11 = 0 THEN 'entry' ELSE 'method' END",
    "file_path": _path("p_partkey"),
    "class_name": "CASE WHEN p_partkey % 3 > 0 THEN concat('pkg.', CASE p_partkey % 7 WHEN 1 THEN 'PayService' WHEN 2 THEN 'OrderController' WHEN 3 THEN 'StockRepo' ELSE 'Thing' END) END",
    "method_name": "concat('m', p_partkey)",
    "language": "'python'",
    "name": "p_name",
}
CALL = {
    "src": _symbol("l_partkey"),
    "dst": _symbol("l_suppkey"),
    "relation": "CASE l_linenumber % 4 WHEN 0 THEN 'IMPORTS' WHEN 1 THEN 'CALLS' WHEN 2 THEN NULL ELSE 'INHERITS' END",
    "condition": "CASE WHEN l_returnflag = 'R' THEN 'returned' END",
    "confidence": "CAST(0.5 + l_discount AS DOUBLE)",
    "is_async": "l_linestatus = 'O'",
}


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table}"


SYMBOLS, CALLS = _select(SYMBOL, "part"), _select(CALL, "lineitem")


def symbols(spark, folder):
    return sources.table(spark, folder, "part").select(*[F.expr(e).alias(c) for c, e in SYMBOL.items()])


def calls(spark, folder):
    return sources.table(spark, folder, "lineitem").select(*[F.expr(e).alias(c) for c, e in CALL.items()])


def _kind_sql(path: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({path}, '{p}') THEN '{name}'" for name, p in codegraph.PATH_KINDS) + " END"


@query(f"SELECT split_part(file_path, '/', 2) AS module, count(*) AS n FROM ({SYMBOLS}) GROUP BY 1")
def code_modules(spark, folder):
    inner = symbols(spark, folder).withColumn("file_path", F.expr("substring(file_path, 5)"))
    return codegraph.module_counts(inner)


@query(f"SELECT class_name, bucket, n FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY n DESC, bucket) AS k FROM (SELECT class_name, bucket, count(*) AS n FROM (SELECT class_name, {_kind_sql('file_path')} AS bucket FROM ({SYMBOLS})) WHERE class_name IS NOT NULL AND bucket IS NOT NULL GROUP BY ALL)) WHERE k = 1")
def code_dominant_kind(spark, folder):
    return codegraph.dominant_kind(symbols(spark, folder).where("class_name IS NOT NULL"), "class_name", "file_path")


KINDS = "CASE p_size % 9 WHEN 0 THEN 'api_rest' WHEN 1 THEN 'kafka' WHEN 2 THEN 'scheduler' WHEN 3 THEN 'main' WHEN 4 THEN 'cli' WHEN 5 THEN 'unknown' WHEN 6 THEN 'other' WHEN 7 THEN 'queue' END"


@query(f"SELECT id, kind, CASE kind WHEN 'api_rest' THEN 0 WHEN 'kafka' THEN 1 WHEN 'queue' THEN 1 WHEN 'scheduler' THEN 2 WHEN 'main' THEN 3 WHEN 'cli' THEN 4 WHEN 'unknown' THEN 5 WHEN 'other' THEN 50 ELSE 90 END AS rank FROM (SELECT p_partkey AS id, {KINDS} AS kind FROM part)")
def code_entry_ranks(spark, folder):
    """Entries in the order in which documents list them."""
    return codegraph.ranked_entries(sources.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.expr(KINDS).alias("kind")))


@query(f"SELECT id, kind FROM (SELECT p_partkey AS id, {KINDS} AS kind FROM part) WHERE kind IN ('kafka', 'queue') ORDER BY id LIMIT 50")
def code_entry_filter(spark, folder):
    """Entries of some kinds, capped."""
    return codegraph.ranked_entries(sources.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.expr(KINDS).alias("kind")), ["kafka", "queue"], 50).select("id", "kind")


@query(f"SELECT id FROM ({SYMBOLS}) WHERE regexp_matches(id, 'api/.*::m.*7$') ORDER BY id LIMIT 25")
def code_symbol_filter(spark, folder):
    return codegraph.matching_symbols(symbols(spark, folder), "api/.*::m.*7$", 25).select("id")


@query(
    f"""WITH s AS ({SYMBOLS}), o AS (SELECT src AS id, count(*) AS n, count(condition) AS c FROM ({CALLS}) GROUP BY src), f AS (SELECT min(id) AS first FROM s), j AS (SELECT s.id, n, c, lower(concat(coalesce(class_name, ''), '.', method_name)) AS t, first FROM s LEFT JOIN o USING (id), f)
    SELECT id, CASE WHEN id = first THEN 'start method' WHEN coalesce(c, 0) > 0 THEN 'decision logic' WHEN contains(t, 'controller') THEN 'controller layer' WHEN contains(t, 'service') THEN 'service layer' WHEN contains(t, 'repo') THEN 'repository / persistence' WHEN n IS NULL THEN 'leaf / terminal' ELSE 'processing method' END AS role FROM j"""
)
def code_roles(spark, folder):
    known = symbols(spark, folder)
    return codegraph.method_roles(known, calls(spark, folder), known.agg(F.min("id")).first()[0])


@query(
    f"""WITH c AS (SELECT DISTINCT src AS id, split_part(dst, '::', -1) AS callee FROM ({CALLS}) WHERE relation = 'CALLS'), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY callee) AS k FROM c), t AS (SELECT id, concat('calls: ', string_agg(callee, ', ' ORDER BY callee)) AS calls FROM k WHERE k <= 5 GROUP BY id)
    SELECT id, concat_ws(' ', method_name, class_name, file_path, language, calls) AS text FROM ({SYMBOLS}) LEFT JOIN t USING (id)"""
)
def code_embedding_text(spark, folder):
    return codegraph.embedding_text(symbols(spark, folder), calls(spark, folder))


CHANGED = "SELECT unnest(['src/api', 'src/core/f3.py', 'src/model/base/', 'src/cor']) AS path"


@query(f"SELECT DISTINCT s.id FROM ({SYMBOLS}) s, ({CHANGED}) c WHERE s.file_path = rtrim(c.path, '/') OR starts_with(s.file_path, concat(rtrim(c.path, '/'), '/'))")
def code_changed_symbols(spark, folder):
    """Symbols of changed files and folders."""
    changed = spark.createDataFrame([("src/api",), ("src/core/f3.py",), ("src/model/base/",), ("src/cor",)], "path string")
    return codegraph.symbols_in(symbols(spark, folder), changed)


ASKED = "SELECT concat(l_orderkey, '-', l_linenumber) AS call, concat('n', l_partkey % 5000) AS label, {0} AS file_path FROM lineitem".format(_path("l_partkey"))


@query(
    f"""WITH s AS (SELECT id, concat('n', CAST(substr(method_name, 2) AS INT) % 5000) AS label, file_path AS in_file FROM ({SYMBOLS})), j AS (SELECT call, s.id AS callee, CASE WHEN in_file = file_path THEN 2 ELSE 0 END AS score FROM ({ASKED}) a JOIN s USING (label))
    SELECT call, callee FROM (SELECT *, row_number() OVER (PARTITION BY call ORDER BY score DESC, length(callee), callee) AS k FROM j) WHERE k = 1"""
)
def code_best_callees(spark, folder):
    """The symbol that each call most likely means."""
    named = symbols(spark, folder).withColumn("method_name", F.expr("concat('n', CAST(substring(method_name, 2) AS INT) % 5000)"))
    rows = sources.table(spark, folder, "lineitem")
    asked = rows.select(F.expr("concat(l_orderkey, '-', l_linenumber)").alias("call"), F.expr("concat('n', l_partkey % 5000)").alias("label"), F.expr(_path("l_partkey")).alias("file_path"))
    return codegraph.best_callees(asked, named)


MODULE = "concat(CASE p_partkey % 4 WHEN 0 THEN '@app' WHEN 1 THEN '@app/core' WHEN 2 THEN '@lib' ELSE 'react' END, CASE WHEN p_partkey % 3 > 0 THEN concat('/x', p_partkey % 13) ELSE '' END)"
ALIASES = [("@app/*", "src/app/*"), ("@app/core/*", "core/src/*"), ("@lib", "lib/index.ts")]


@query(
    f"""WITH a AS (SELECT * FROM (VALUES {', '.join(map(str, ALIASES))}) v(pattern, base)), m AS (SELECT p_partkey AS src, {MODULE} AS module FROM part),
    p AS (SELECT *, replace(pattern, '/*', '') AS stem, replace(base, '/*', '') AS root, pattern LIKE '%/*' AS open FROM a),
    j AS (SELECT src, module, root, substr(module, length(stem) + 2) AS rest, row_number() OVER (PARTITION BY src, module ORDER BY length(stem) DESC, base DESC) AS k FROM m JOIN p ON module = stem OR open AND starts_with(module, concat(stem, '/')))
    SELECT src, module, concat_ws('/', root, nullif(rest, '')) AS path FROM j WHERE k = 1"""
)
def code_aliases(spark, folder):
    """Modules by the longest alias that fits."""
    imports = sources.table(spark, folder, "part").select(F.col("p_partkey").alias("src"), F.expr(MODULE).alias("module"))
    return codegraph.expanded_modules(imports, spark.createDataFrame(ALIASES, "pattern string, base string"))


IMPORT = "SELECT DISTINCT concat('file:', {0}) AS src, concat('external::src.', CASE l_suppkey % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'api.v1' WHEN 2 THEN 'both' ELSE 'none' END, '.f', l_suppkey % 17) AS dst, 'IMPORTS' AS relation, 0.8 AS confidence FROM lineitem"


@query(
    f"""WITH i AS ({IMPORT.format(_path("l_partkey"))}), f AS (SELECT DISTINCT file_path AS path FROM ({SYMBOLS})), c AS (SELECT src, dst, replace(substr(dst, 11), '.', '/') AS base FROM i), t AS (SELECT src, dst, unnest([concat(base, '.py'), concat(base, '/__init__.py')]) AS path FROM c)
    SELECT src, concat('file:', min(path)) AS dst, 'IMPORTS' AS relation, 0.9::DOUBLE AS confidence, dst AS resolved_from FROM t JOIN f USING (path) GROUP BY src, t.dst HAVING count(DISTINCT path) = 1 AND src <> concat('file:', min(path))"""
)
def code_imports(spark, folder):
    """Imports of modules that stand for exactly one known file."""
    rows = sources.table(spark, folder, "lineitem")
    module = "concat('external::src.', CASE l_suppkey % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'api.v1' WHEN 2 THEN 'both' ELSE 'none' END, '.f', l_suppkey % 17)"
    asked = rows.select(F.expr(f"concat('file:', {_path('l_partkey')})").alias("src"), F.expr(module).alias("dst"), F.lit("IMPORTS").alias("relation"), F.lit(0.8).alias("confidence")).distinct()
    return codegraph.resolved_imports(asked, symbols(spark, folder).select(F.col("file_path").alias("path")))


@query(f"SELECT repo, count(*) AS n, min(src) AS first_src, max(dst) AS last_dst FROM (SELECT 'a' AS repo, concat('a::', src) AS src, concat('a::', dst) AS dst FROM ({CALLS}) UNION ALL SELECT 'b', concat('b::', src), concat('b::', dst) FROM ({CALLS}) WHERE is_async) GROUP BY repo")
def code_merged_repos(spark, folder):
    """Two repos as one graph of disjoint parts."""
    known, links = symbols(spark, folder), calls(spark, folder)
    _, merged = codegraph.merged_repos({"a": (known, links), "b": (known, links.where("is_async"))})
    return merged.groupBy("repo").agg(F.count("*").alias("n"), F.min("src").alias("first_src"), F.max("dst").alias("last_dst"))


CLASS = "concat('class:', file_path, '::', class_name)"
SCHEMA_NODES = f"SELECT DISTINCT concat('file:', file_path) AS id, 'File' AS kind, split_part(file_path, '/', -1) AS name, file_path FROM ({SYMBOLS}) UNION ALL SELECT DISTINCT {CLASS}, 'Class', split_part(class_name, '.', -1), file_path FROM ({SYMBOLS}) WHERE class_name IS NOT NULL UNION ALL SELECT id, concat(upper(kind[1]), kind[2:]), method_name, file_path FROM ({SYMBOLS})"


@query(SCHEMA_NODES)
def code_schema_nodes(spark, folder):
    """Files, classes and symbols as nodes."""
    return codegraph.stable_schema(symbols(spark, folder), calls(spark, folder))[0]


@query(
    f"""SELECT src, dst, relation, max(confidence) AS confidence FROM (SELECT concat('file:', file_path) AS src, {CLASS} AS dst, 'CONTAINS' AS relation, 1.0::DOUBLE AS confidence FROM ({SYMBOLS}) WHERE class_name IS NOT NULL
    UNION ALL SELECT CASE WHEN class_name IS NULL THEN concat('file:', file_path) ELSE {CLASS} END, id, 'CONTAINS', 1.0 FROM ({SYMBOLS}) UNION ALL SELECT src, dst, coalesce(relation, 'CALLS'), confidence FROM ({CALLS})
    UNION ALL SELECT src, dst, 'ASYNC', confidence FROM ({CALLS}) WHERE coalesce(relation, 'CALLS') = 'CALLS' AND is_async) GROUP BY ALL"""
)
def code_schema_edges(spark, folder):
    """What files and classes contain, and calls with their asynchronous twins."""
    return codegraph.stable_schema(symbols(spark, folder), calls(spark, folder))[1]


TEAM = f"SELECT split_part(file_path, '/', 2) AS community, id AS node, file_path FROM ({SYMBOLS})"
FOLDER = f"SELECT community, array_to_string(low[1:list_max(list_filter(range(0, least(len(low), len(high)) + 1), lambda k: low[1:k] = high[1:k]))], '/') AS folder FROM (SELECT community, min(string_split(file_path, '/')) AS low, max(string_split(file_path, '/')) AS high FROM ({TEAM}) GROUP BY community)"


@query(
    f"""WITH m AS ({TEAM}), p AS (SELECT DISTINCT community, file_path FROM m), b AS (SELECT community, bucket FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, bucket) AS k FROM (SELECT community, bucket, count(*) AS n FROM (SELECT community, {_kind_sql('file_path')} AS bucket FROM p) WHERE bucket IS NOT NULL GROUP BY ALL)) WHERE k = 1),
    e AS (SELECT a.community, count(*) AS n, count(*) FILTER (relation = 'CALLS') AS c, count(*) FILTER (relation = 'IMPORTS') AS i FROM ({CALLS}) x JOIN m a ON a.node = src JOIN m z ON z.node = dst WHERE a.community = z.community GROUP BY ALL),
    l AS (SELECT m.community, concat_ws('/', any_value(bucket), any_value(folder), CASE WHEN any_value(c) / any_value(n) >= 0.5 THEN 'call_dense' WHEN any_value(i) / any_value(n) >= 0.5 THEN 'import_dense' END) AS label, CASE WHEN any_value(bucket) IS NULL THEN 0.6 ELSE 0.75 END AS confidence, count(DISTINCT node) AS n_members, min(node) AS first
    FROM m LEFT JOIN b USING (community) LEFT JOIN ({FOLDER}) USING (community) LEFT JOIN e USING (community) GROUP BY m.community)
    SELECT CAST(row_number() OVER (ORDER BY label, first) - 1 AS INTEGER) AS place, community, label, confidence::DOUBLE AS confidence, n_members FROM l"""
)
def code_community_labels(spark, folder):
    """Folders as communities, with labels by rule."""
    members = symbols(spark, folder).select(F.split_part("file_path", F.lit("/"), F.lit(2)).alias("community"), F.col("id").alias("node"), "file_path")
    return codegraph.community_labels(members, calls(spark, folder))


@query(f"SELECT label, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN kind = 'entry' THEN 'entry' ELSE 'code' END AS label, count(*) AS n FROM ({SYMBOLS}) GROUP BY 1) GROUP BY label")
def code_label_sizes(spark, folder):
    named = symbols(spark, folder).groupBy(F.when(F.col("kind") == "entry", "entry").otherwise("code").alias("label")).agg(F.count("*").alias("n_members"))
    return codegraph.label_sizes(named)


@query("SELECT label, count(*) AS n FROM (SELECT unnest([p_brand, p_type]) AS label FROM part) GROUP BY label")
def graph_label_histogram(spark, folder):
    return codegraph.label_histogram(sources.table(spark, folder, "part").select(F.array("p_brand", "p_type").alias("labels")), "labels")


SENT = "CASE WHEN event_type = 'purchase' THEN concat('kafka.send(\"t', event_id % 13, '\", x)') ELSE event_type END"


@query(
    """WITH l AS (SELECT concat('f', user_id % 5) AS file, event_id AS line, event_type, concat('m', event_id % 9) AS caller, concat('topic:t', event_id % 13) AS topic FROM events),
    s AS (SELECT file, line, topic FROM l WHERE event_type = 'purchase'), c AS (SELECT file, line, caller FROM l WHERE event_type = 'click'),
    p AS (SELECT s.*, arg_max(caller, c.line) AS caller FROM s JOIN c ON c.file = s.file AND c.line <= s.line GROUP BY ALL)
    SELECT DISTINCT caller AS src, topic AS dst, 'EVENT' AS relation, 'producer' AS role, 0.55::DOUBLE AS confidence FROM p
    UNION ALL SELECT DISTINCT concat('topic:t', event_id % 13), concat('h', event_id % 4), 'EVENT', 'consumer', 0.9 FROM events WHERE event_type = 'signup'"""
)
def code_topics(spark, folder):
    """Who sends to topics, as of the last call before, and who listens."""
    events = sources.table(spark, folder, "events").withColumn("file", F.expr("concat('f', user_id % 5)"))
    lines = events.select("file", F.col("event_id").alias("line"), F.expr(SENT).alias("text"))
    called = events.where("event_type = 'click'").select("file", F.col("event_id").alias("line"), F.expr("concat('m', event_id % 9)").alias("caller"))
    listeners = events.where("event_type = 'signup'").select(F.expr("concat('h', event_id % 4)").alias("symbol"), F.array(F.expr("concat('t', event_id % 13)")).alias("topics"))
    return codegraph.topic_edges(lines, called, listeners)


@query(f"WITH e AS ({SQL['code_topics']}) SELECT DISTINCT a.src AS producer, a.dst AS topic, b.dst AS consumer FROM e a JOIN e b ON a.dst = b.src WHERE a.role = 'producer'")
def code_event_chains(spark, folder):
    return codegraph.event_chains(QUERIES["code_topics"](spark, folder)).select("producer", "topic", "consumer")


TREE = "SELECT DISTINCT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"


@query(
    f"""WITH RECURSIVE e AS (SELECT * FROM ({TREE}) WHERE dst IS NOT NULL), w AS (SELECT ['view'] AS path, false AS back_edge UNION ALL SELECT list_append(w.path, e.dst), list_contains(w.path, e.dst) FROM w JOIN e ON e.src = w.path[-1] WHERE NOT back_edge AND len(w.path) <= 3)
    SELECT array_to_string(path, '>') AS path, path[-1] AS node, CAST(len(path) - 1 AS INTEGER) AS depth, back_edge FROM w"""
)
def code_flow_tree(spark, folder):
    """The ways from an event, up to three steps."""
    steps = graph.transitions(sources.table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type")
    return codegraph.flow_tree(steps, "view", 3)


@query(f"SELECT node, CAST(place AS INTEGER) AS place, concat('- `', dst, '` (', relation, ')') AS line FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY relation, dst) AS place FROM (SELECT DISTINCT src AS node, coalesce(relation, 'CALLS') AS relation, dst FROM ({CALLS}))) WHERE place <= 20")
def code_dependency_bullets(spark, folder):
    return codegraph.dependency_bullets(calls(spark, folder), 20)


@query(f"WITH n AS (SELECT id FROM ({SYMBOLS}) ORDER BY id LIMIT 40) SELECT src, dst, relation, condition FROM ({CALLS}) WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def graph_induced(spark, folder):
    """Edges between the first forty symbols."""
    kept, _ = codegraph.capped(symbols(spark, folder), calls(spark, folder), 40, 1)
    return graph.induced(calls(spark, folder), kept.select(F.col("id").alias("node"))).select("src", "dst", "relation", "condition")


@query(f"WITH n AS (SELECT id FROM ({SYMBOLS}) ORDER BY id LIMIT 100), e AS (SELECT src, dst, coalesce(relation, '') AS relation FROM ({CALLS}) WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) ORDER BY relation, src, dst LIMIT 60) SELECT src, dst, relation FROM e")
def graph_capped(spark, folder):
    """Stable caps: the first nodes, and the first edges between them."""
    links = calls(spark, folder).withColumn("relation", F.coalesce("relation", F.lit("")))
    return codegraph.capped(symbols(spark, folder), links, 100, 60)[1].select("src", "dst", "relation")


@query(f"SELECT src, dst, relation FROM ({CALLS}) WHERE relation IN ('CALLS', 'IMPORTS') AND (src IN (SELECT id FROM ({SYMBOLS}) WHERE method_name = 'm7') OR dst IN (SELECT id FROM ({SYMBOLS}) WHERE method_name = 'm7')) ORDER BY src, dst, relation LIMIT 5000")
def graph_pattern_query(spark, folder):
    """A question in the pattern language, with a condition on either end."""
    return codegraph.pattern_query(symbols(spark, folder), calls(spark, folder), 'MATCH (a)-[CALLS|IMPORTS]->(b) WHERE name = "m7"')


QUESTION = "CASE p_partkey % 6 WHEN 0 THEN concat('Who calls `m', p_partkey, '`?') WHEN 1 THEN concat('impact for m', p_partkey) WHEN 2 THEN 'what is related to it' WHEN 3 THEN 'async call chains' WHEN 4 THEN concat('what depends on it, asked by m', p_partkey) ELSE 'hello' END"


@query(
    f"""WITH q AS (SELECT p_partkey AS question, {QUESTION} AS t, CASE p_partkey % 6 WHEN 0 THEN 'called_by' WHEN 1 THEN 'impact' WHEN 2 THEN 'semantic_search' WHEN 3 THEN 'event_flow' WHEN 4 THEN 'references' ELSE 'unknown' END AS intent, CASE WHEN p_partkey % 6 IN (0, 1, 4) THEN concat('m', p_partkey) END AS hint FROM part)
    SELECT question, intent, hint, s.id AS node FROM q LEFT JOIN ({SYMBOLS}) s ON s.method_name = hint"""
)
def graph_questions(spark, folder):
    """Questions in words: what they ask for, and of which symbol."""
    asked = sources.table(spark, folder, "part").select(F.col("p_partkey").alias("question"), F.expr(QUESTION).alias("t"))
    asked = asked.select("question", codegraph.intent(F.col("t")).alias("intent"), F.when(codegraph.intent(F.col("t")).isin(*codegraph.ABOUT_SYMBOLS), codegraph.target_hint(F.col("t"))).alias("hint"))
    found = codegraph.resolved_hints(asked.where("hint IS NOT NULL").select("question", "hint"), symbols(spark, folder))
    return asked.join(found, "question", "left").select("question", "intent", "hint", "node")


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({CALLS}) WHERE src <> dst), d AS (SELECT src AS node FROM ({CALLS}) WHERE src <> dst GROUP BY src ORDER BY count(*) DESC, src LIMIT 300), w AS (SELECT node AS seed, node FROM d UNION SELECT w.seed, e.dst FROM w JOIN e ON e.src = w.node) SELECT seed, count(*) - 1 AS n_reached FROM w GROUP BY seed HAVING n_reached > 0 ORDER BY n_reached DESC, seed LIMIT 10")
def graph_top_impacted(spark, folder):
    """Of the 300 symbols that call most, those whose change reaches most."""
    links = calls(spark, folder).where("src <> dst")
    return codegraph.top_impacted(links, links.select(F.col("src").alias("node")).distinct())


@query("SELECT l_orderkey AS src, l_partkey AS dst, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS conditions, min(l_discount) AS confidence, bool_or(l_linestatus = 'O') AS is_async, count(*) AS n FROM lineitem GROUP BY ALL")
def graph_merged_flags(spark, folder):
    """Parallel edges as one: all conditions, the least confidence, and whether any is asynchronous."""
    rows = sources.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("CALLS").alias("relation"), F.col("l_returnflag").alias("condition"), F.col("l_discount").alias("confidence"), (F.col("l_linestatus") == "O").alias("is_async"))
    return graph.merged(rows, "is_async").drop("relation")


@query(f"WITH n AS (SELECT 'node' AS part, concat('{{\"id\":\"', id, '\",\"kind\":\"', kind, '\"}}') AS line FROM ({SYMBOLS})) SELECT * FROM n UNION ALL SELECT 'edge', concat('{{\"dst\":\"', dst, '\",\"relation\":\"', coalesce(relation, 'CALLS'), '\",\"src\":\"', src, '\"}}') FROM ({CALLS})")
def graph_json(spark, folder):
    """The whole graph as JSON lines."""
    return sinks.graph_json(symbols(spark, folder).select("id", "kind"), calls(spark, folder).select("src", "dst", F.coalesce("relation", F.lit("CALLS")).alias("relation")))


@query(f"SELECT DISTINCT concat('  \"', src, '\" -> \"', dst, '\" [label=\"', coalesce(relation, 'CALLS'), '\"];') AS line FROM ({CALLS})")
def graph_dot(spark, folder):
    return sinks.dot_lines(calls(spark, folder))


@query(f"SELECT DISTINCT concat('    ', upper(dst), ' ||--o{{ ', upper(src), ' : \"key\"') AS line FROM ({KEYS_SQL})")
def catalog_entities(spark, folder):
    """Foreign keys as lines of an entity diagram."""
    return sinks.er_lines(spark.createDataFrame([(a, "key", b) for a, _, b in FOREIGN_KEYS], "src string, column string, dst string"))


@query(f"SELECT CASE p_size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'dynamic' ELSE 'static' END AS resolution, CASE p_size % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence, count(*) AS n FROM part GROUP BY ALL")
def code_call_confidence(spark, folder):
    rows = sources.table(spark, folder, "part").select(F.expr("CASE p_size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'dynamic' ELSE 'static' END").alias("resolution"))
    return rows.groupBy("resolution", codegraph.call_confidence(F.col("resolution")).cast("double").alias("confidence")).agg(F.count("*").alias("n"))
