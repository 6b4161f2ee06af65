"""Queries over cells, names, texts, Markdown and API descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import sources
from tidemark.functions import markup
from tidemark.operators import graph, openapi, tables, trees
from tidemark.plans.queries import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("SELECT p_name, p_size FROM part WHERE lower(trim(p_brand)) IN ('brand#11', 'brand#23', 'brand#32')")
def table_columns(spark, folder):
    """Columns by names in any case, and rows by names likewise."""
    rows = sources.table(spark, folder, "part")
    return tables.project(tables.named(rows, "p_brand", ["brand#11", " BRAND#23", "Brand#32"]), [" P_NAME", "p_Size"])


CELL = "CASE WHEN {0} IS NULL OR isnan({0}) THEN '' WHEN {0} = floor({0}) THEN CAST({0}::BIGINT AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@query(
    f"""SELECT -2 AS place, '| p_name | p_size | half |' AS line UNION ALL SELECT -1, '| :--- | ---: | :--- |'
    UNION ALL SELECT p_partkey, concat('| ', replace(replace(trim(p_name), chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), ' | ', p_size, ' | ', {CELL.format('(p_size / 2.0)::DOUBLE')}, ' |') FROM part"""
)
def table_markdown(spark, folder):
    """A whole Markdown table: header, alignment and rows."""
    rows = sources.table(spark, folder, "part").withColumn("half", F.col("p_size") / 2.0)
    return tables.gfm_table(rows, "p_partkey", ["p_name", "p_size", "half"], ["left", "right"])


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 3 = 0 THEN CAST(event_id // 3 AS VARCHAR) ELSE CAST(event_id % 4 + 0.5 AS VARCHAR) END AS number, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def table_cells(spark, folder):
    """Cells as a table shows them: no NaN, no point of whole numbers, ISO times."""
    number = "CASE WHEN event_id % 5 = 0 THEN double('NaN') WHEN event_id % 3 = 0 THEN double(event_id div 3) ELSE event_id % 4 + 0.5D END"
    rows = sources.table(spark, folder, "events").select("event_id", F.expr(number).alias("number"), "ts")
    return rows.select("event_id", tables.cell_text(rows, "number").alias("number"), tables.cell_text(rows, "ts").alias("at"))


ODD = "CASE doc_id % 4 WHEN 0 THEN concat(text, repeat(chr(1), CAST(length(text) AS INT) // 8 + 1)) ELSE coalesce(text, '') END"


@query(f"SELECT doc_id FROM (SELECT doc_id, {ODD} AS t FROM documents) WHERE t = '' OR 1 - (length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))) / length(t) > 0.92")
def text_readable(spark, folder):
    """Documents that aren't binary; every fourth one gets control characters first."""
    docs = sources.table(spark, folder, "documents").select("doc_id", F.expr(ODD.replace("CAST(length(text) AS INT) // 8", "CAST(length(text) div 8 AS INT)").replace("chr(1)", "char(1)")).alias("text"))
    return tables.readable(docs).select("doc_id")


def _slug_sql(text: str, kind: str) -> str:
    pattern, mark, size = tables.SLUGS[kind]
    return f"coalesce(nullif(substr(regexp_replace(regexp_replace(lower(trim({text})), '{pattern}', '{mark}', 'g'), '^{mark}+|{mark}+$', '', 'g'), 1, {size}), ''), 'x')"


@query(f"SELECT page_id, {', '.join(f'{_slug_sql("url", k)} AS {k}' for k in tables.SLUGS)} FROM pages")
def name_slugs(spark, folder):
    """File-safe names of addresses, in each of the ways."""
    return sources.table(spark, folder, "pages").select("page_id", *[tables.slug(F.col("url"), k).alias(k) for k in tables.SLUGS])


WITH_USER = "concat(' ', CASE page_id % 2 WHEN 0 THEN replace(url, '://', '://me:pw@') ELSE concat(url, '#part') END, ' ')"


@query(f"SELECT page_id, regexp_replace(trim({WITH_USER}), '#.*$', '') AS url, regexp_replace({WITH_USER}, '(://)[^/@\\s]+@', '\\1***@', 'g') AS shown FROM pages")
def name_urls(spark, folder):
    """Addresses without fragments, and without passwords."""
    own = F.expr(WITH_USER)
    return sources.table(spark, folder, "pages").select("page_id", tables.normalized_url(own).alias("url"), tables.redacted_uri(own).alias("shown"))


GAPS = "concat(chr(10), ' ', coalesce(text, ''), chr(10), '  ', chr(10), chr(10), 'end', chr(10))"


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace({GAPS}, '\\n[ \\t]*(\\n[ \\t]*)+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def text_single_blanks(spark, folder):
    """Texts with single blank lines."""
    gaps = F.expr(GAPS.replace("chr(10)", "char(10)"))
    return sources.table(spark, folder, "documents").select("doc_id", F.sha2(tables.single_blank_lines(gaps), 256).alias("digest"))


@query()
def text_cut_bytes(spark, folder):
    """Texts of at most 100 bytes, characters whole, with a notice."""
    return sources.table(spark, folder, "documents").select("doc_id", tables.cut_bytes(F.coalesce("text", F.lit("")), 100).alias("text"))


FILES = "concat('src/f', p_partkey, CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.JAVA' WHEN 2 THEN '.tsx' WHEN 3 THEN '.hpp' WHEN 4 THEN '' WHEN 5 THEN '.tar.gz' ELSE '.sql' END)"


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'tsx' WHEN 3 THEN 'cpp' WHEN 6 THEN 'sql' ELSE 'mixed' END AS language FROM part")
def name_languages(spark, folder):
    return sources.table(spark, folder, "part").select("p_partkey", tables.language(F.expr(FILES)).alias("language"))


@query("SELECT page_id, replace(replace(replace(html, 'https://', 'HTTPS:'), 'https:', 'h:'), 'href', 'link') AS html FROM pages")
def page_rewritten(spark, folder):
    """Parts of pages replaced, the longest first."""
    table = {"href": "link", "https:": "h:", "https://": "HTTPS:"}
    return sources.table(spark, folder, "pages").select("page_id", tables.replaced(F.col("html"), table).alias("html"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('../y/t', p_partkey, '.md') WHEN 1 THEN concat('t', p_partkey, '.md') ELSE concat('../../t', p_partkey, '.md') END AS link FROM part")
def name_relative_paths(spark, folder):
    """The way from one document to another."""
    target = "CASE p_partkey % 3 WHEN 0 THEN concat('a/y/t', p_partkey, '.md') WHEN 1 THEN concat('a/x/t', p_partkey, '.md') ELSE concat('t', p_partkey, '.md') END"
    return sources.table(spark, folder, "part").select("p_partkey", tables.relative_path(F.lit("a/x/doc.md"), F.expr(target)).alias("link"))


@query("SELECT source, text FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, n_chars, text DESC) AS k FROM documents WHERE trim(text) <> '') WHERE k = 1")
def text_longest(spark, folder):
    """The longest text of each source."""
    return tables.longest_text(sources.table(spark, folder, "documents").select("source", "text", "n_chars"), "source", "text", "n_chars")


@query("SELECT p_partkey, p_size >= 1.15 * m AND p_size >= m + 1.5 AS heading FROM part JOIN (SELECT p_brand, median(p_size) AS m FROM part GROUP BY p_brand) USING (p_brand)")
def text_headings(spark, folder):
    """Spans that are larger than their page's median."""
    return tables.headings(sources.table(spark, folder, "part"), "p_brand", "p_size").select("p_partkey", "heading")


@query(
    """WITH i AS (SELECT conv_id AS doc, turn AS place, turn * 7 % 3 + 1 AS level FROM conversations), a AS (SELECT i.*, coalesce((SELECT max(j.place) FROM i j WHERE j.doc = i.doc AND j.place < i.place AND j.level < i.level), -1) AS above FROM i)
    SELECT doc, place, level, CAST(row_number() OVER (PARTITION BY doc, level, above ORDER BY place) AS INTEGER) AS number FROM a"""
)
def text_list_numbers(spark, folder):
    """Numbers of nested lists."""
    items = sources.table(spark, folder, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("place"), (F.col("turn") * 7 % 3 + 1).alias("level"))
    return tables.list_numbers(items, "doc", "place", "level")


BODY = """CASE p_partkey % 5 WHEN 0 THEN concat(' {"a":', p_partkey, '}') WHEN 1 THEN '<a><b/></a> ' WHEN 2 THEN '{broken' WHEN 3 THEN '[1, 2]' ELSE 'plain' END"""


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'xml' WHEN p_partkey % 5 IN (0, 3) THEN 'json' WHEN p_partkey % 5 = 1 THEN 'xml' ELSE 'txt' END AS format FROM part")
def text_formats(spark, folder):
    """Formats by suffix, or else by content."""
    return sources.table(spark, folder, "part").select("p_partkey", tables.detected_format(F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'f.XML' ELSE 'f' END"), F.expr(BODY)).alias("format"))


ORDER_JSON = """concat('{"order_key":', o_orderkey, ',"who":{"cust":', o_custkey, ',"none":null},"items":[{"k":1,"v":"a|b"},{"k":2,"v":"c"}],"tags":["x",', o_orderkey % 3, ']}')"""


@query(
    "SELECT o_orderkey, concat('- **Order Key:** ', o_orderkey, chr(10), chr(10), '## Who', chr(10), '- **Cust:** ', o_custkey, chr(10), '- **None:** ', chr(10), chr(10), '## Items', chr(10), chr(10), '| K | V |', chr(10), '| --- | --- |', chr(10), '| 1 | a', chr(92), '|b |', chr(10), '| 2 | c |', chr(10), chr(10), '## Tags', chr(10), '- x', chr(10), '- ', o_orderkey % 3) AS text FROM orders"
)
def json_markdown(spark, folder):
    """JSON documents as headings, bullets and tables."""
    return trees.json_markdown(sources.table(spark, folder, "orders").select("o_orderkey", F.expr(ORDER_JSON).alias("text")), "o_orderkey")


@query("SELECT o_orderkey, concat('## Items 0', chr(10), '- **k:** 1', chr(10), '- **v:** a|b', chr(10), chr(10), '## Items 1', chr(10), '- **k:** 2', chr(10), '- **v:** c', chr(10), chr(10), '## Order Key', chr(10), '- ', o_orderkey, chr(10), chr(10), '## Tags 0', chr(10), '- x', chr(10), chr(10), '## Tags 1', chr(10), '- ', o_orderkey % 3, chr(10), chr(10), '## Who', chr(10), '- **cust:** ', o_custkey, chr(10), '- **none:** null') AS text FROM orders")
def json_flat_markdown(spark, folder):
    """Flattened JSON under a heading for each first segment."""
    return trees.flat_markdown(sources.table(spark, folder, "orders").select("o_orderkey", F.expr(ORDER_JSON).alias("text")), "o_orderkey")


ORDER_XML = "concat('<order id=\"', o_orderkey, '\"><who>c', o_custkey, '</who><items><item><k>1</k><v>a|b</v></item><item><k>2</k><v>c</v></item></items></order>')"


@query("SELECT o_orderkey, concat('## Order', chr(10), '- **id:** ', o_orderkey, chr(10), chr(10), '### Who', chr(10), chr(10), 'c', o_custkey, chr(10), chr(10), '### Items', chr(10), chr(10), '| k | v |', chr(10), '| --- | --- |', chr(10), '| 1 | a', chr(92), '|b |', chr(10), '| 2 | c |') AS text FROM orders")
def xml_markdown(spark, folder):
    """XML documents as headings, bullets and tables."""
    return trees.xml_markdown(sources.table(spark, folder, "orders").select("o_orderkey", F.expr(ORDER_XML).alias("text")), "o_orderkey")


@query("SELECT doc_id, concat('---', chr(10), 'lang: ', lang, chr(10), 'source: ', source, chr(10), '---', chr(10)) AS head, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def text_front_matter(spark, folder):
    """Front matter of documents, and a field of it read back."""
    docs = sources.table(spark, folder, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    headed = docs.select("doc_id", markup.front_matter({"source": F.col("source"), "lang": F.col("lang")}).alias("head"))
    return headed.withColumn("lang", markup.front_matter_field(F.col("head"), "lang"))


SPEC = """concat('{"openapi":"3.0.0","paths":{"/n', n_nationkey, '/{id}":{"parameters":[{"name":"id","in":"path","schema":{"type":"string"}},{"name":"gone","in":"path"}],"get":{"operationId":"get', n_nationkey, '","responses":{"200":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/S', n_regionkey, '"}}}}}},
"post":{"summary":" new ","tags":["t"],"security":[{"key":[]}],"requestBody":{"content":{"application/json":{"schema":{"allOf":[{"$ref":"#/components/schemas/S', n_nationkey % 4, '"},{"type":"object","required":["b"],"properties":{"b":{"type":"integer"},"a":{"enum":["z","y"]}}}]}}}},"responses":{}}}}}')"""
OPERATIONS_SQL = """SELECT concat('spec', n_nationkey) AS spec, concat('/n', n_nationkey, '/{id}') AS path, m AS method, CASE m WHEN 'get' THEN concat('get', n_nationkey) ELSE concat('post_/n', n_nationkey, '/{id}') END AS operation_id, CASE m WHEN 'get' THEN 'read' ELSE 'create' END AS intent, 'path:id' AS parameters,
CASE m WHEN 'post' THEN 'application/json' ELSE '' END AS media_types, CASE m WHEN 'post' THEN concat('#/components/schemas/S', n_nationkey % 4) ELSE '' END AS request_refs, CASE m WHEN 'get' THEN concat('#/components/schemas/S', n_regionkey) ELSE '' END AS response_refs, CASE m WHEN 'post' THEN 'key' ELSE '' END AS security, CASE m WHEN 'post' THEN '{"a": "y", "b": 0}' END AS sample FROM nation, (VALUES ('get'), ('post')) v(m)"""


def _operations(spark, folder):
    return openapi.operations(sources.table(spark, folder, "nation").select(F.concat(F.lit("spec"), "n_nationkey").alias("spec"), F.expr(SPEC).alias("text")))


@query(OPERATIONS_SQL)
def api_operations(spark, folder):
    """Operations of API documents, with what they take, give and refer to."""
    found = _operations(spark, folder)
    lists = ("parameters", "media_types", "request_refs", "response_refs", "security")
    return found.select("spec", "path", "method", "operation_id", openapi.crud_intent(F.col("method")).alias("intent"), *[F.array_join(c, ",").alias(c) for c in lists], "sample")


@query(f"SELECT DISTINCT a.operation_id AS src, b.operation_id AS dst FROM ({OPERATIONS_SQL}) a JOIN ({OPERATIONS_SQL}) b ON a.response_refs = b.request_refs WHERE a.response_refs <> '' AND a.operation_id <> b.operation_id")
def api_dependencies(spark, folder):
    """Operations whose answers hold what others ask for."""
    found = _operations(spark, folder).select(F.col("operation_id").alias("endpoint"), F.col("response_refs").alias("responses"), F.col("request_refs").alias("requests"))
    return graph.shared_references(found)


@query(f"SELECT operation_id, 'valid_request' AS name, coalesce(sample, '{{}}') AS body FROM ({OPERATIONS_SQL})")
def api_test_cases(spark, folder):
    return openapi.test_cases(_operations(spark, folder))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'api_key' WHEN 1 THEN 'http_bearer' WHEN 2 THEN 'other' WHEN 3 THEN 'oauth2' ELSE 'openid' END AS auth FROM nation")
def api_auth_kinds(spark, folder):
    kind, scheme = "CASE n_nationkey % 5 WHEN 0 THEN 'apiKey' WHEN 1 THEN 'http' WHEN 2 THEN 'http' WHEN 3 THEN 'oauth2' ELSE 'openIdConnect' END", "CASE n_nationkey % 5 WHEN 1 THEN 'Bearer' ELSE 'basic' END"
    return sources.table(spark, folder, "nation").select("n_nationkey", openapi.auth_kind(F.expr(kind), F.expr(scheme)).alias("auth"))


@query("SELECT DISTINCT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE toxic = 0")
def rows_intersection(spark, folder):
    """Rows in both of two selections."""
    return sources.table(spark, folder, "documents").where("lang = 'en'").select("doc_id").intersect(sources.table(spark, folder, "labels").where("toxic = 0").select("doc_id"))
