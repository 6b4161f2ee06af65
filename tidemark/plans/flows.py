"""Queries over control-flow graphs, slices, entries, communities and imports between repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import sources
from tidemark.operators import codegraph, flows, modularity
from tidemark.plans.queries import EDGES, QUERIES, SQL, edges, query

__all__ = ["QUERIES", "SQL"]

# A function a supplier: a branch, then a loop around a switch of one to three cases; every fourth branch was measured.
STEPS = """SELECT s_suppkey AS graph, src, dst, label, place, measured FROM supplier, (VALUES
('start', 'if', CAST(NULL AS VARCHAR), 0), ('if', 'a', 'then', 0), ('if', 'b', 'else', 1), ('a', 'loop', NULL, 0), ('b', 'loop', NULL, 0), ('loop', 'switch', 'repeat', 0), ('loop', 'end', 'exit', 1),
('switch', 'x0', 'case', 0), ('switch', 'x1', 'case', 1), ('switch', 'x2', 'default', 2), ('x0', 'loop', NULL, 0), ('x1', 'loop', NULL, 0), ('x2', 'loop', NULL, 0)) v(src, dst, label, place),
LATERAL (SELECT CASE WHEN src = 'if' AND s_suppkey % 4 = 0 THEN CASE label WHEN 'then' THEN 0.9 ELSE 0.1 END END AS measured)
WHERE NOT (src = 'switch' AND place > s_suppkey % 3)"""
KINDS = "CASE node WHEN 'start' THEN 'START' WHEN 'if' THEN 'IF' WHEN 'loop' THEN 'LOOP_HDR' WHEN 'switch' THEN 'SWITCH' WHEN 'end' THEN 'END' ELSE 'CALL' END"


@query(
    f"""WITH RECURSIVE e AS ({STEPS}), p AS (SELECT *, CASE WHEN measured IS NOT NULL THEN measured::DOUBLE WHEN src = 'if' THEN 0.5 WHEN src = 'loop' AND label = 'repeat' THEN 0.6 WHEN src = 'loop' THEN 0.4 WHEN src = 'switch' THEN 1.0 / count(*) OVER (PARTITION BY graph, src) ELSE 1.0 END::DOUBLE AS p FROM e),
    w AS (SELECT s_suppkey AS graph, 'start' AS node, ['start'] AS path, []::INTEGER[] AS places, 1.0::DOUBLE AS p FROM supplier
      UNION ALL SELECT w.graph, p.dst, list_append(w.path, p.dst), list_append(w.places, p.place), w.p * p.p FROM w JOIN p ON p.graph = w.graph AND p.src = w.node
      WHERE w.node <> 'end' AND (w.node <> 'loop' OR len(list_filter(w.path, lambda x: x = 'loop')) <= 2 OR p.label = 'exit')),
    r AS (SELECT graph, path, p, row_number() OVER (PARTITION BY graph ORDER BY places) AS rank, count(*) OVER (PARTITION BY graph) > 10 AS truncated FROM w WHERE node = 'end')
    SELECT graph, CAST(rank AS INTEGER) AS rank, array_to_string(path, '>') AS path, round(p, 9) AS probability, truncated FROM r WHERE rank <= 10"""
)
def flow_paths(spark, folder):
    """The first ten paths of each function, loops taken twice at most."""
    sources.table(spark, folder, "supplier").createOrReplaceTempView("flow_suppliers")
    steps = spark.sql(STEPS.replace("VARCHAR", "STRING").replace("FROM supplier", "FROM flow_suppliers"))
    nodes = steps.select("graph", "src").union(steps.select("graph", "dst")).distinct().toDF("graph", "node").withColumn("kind", F.expr(KINDS))
    paths, whole = flows.control_paths(nodes, steps, max_paths=10)
    return paths.join(whole.hint("merge"), "graph").select("graph", "rank", F.array_join("path", ">").alias("path"), F.round("probability", 9).alias("probability"), "truncated")


SLICE_SEEDS = "SELECT concat('c', c_custkey) AS node FROM customer WHERE c_custkey % 10 = 0"


@query(
    f"""WITH RECURSIVE e AS (SELECT src, dst, relation FROM ({EDGES}) WHERE relation <> 'CONTAINS'), u AS (SELECT DISTINCT src, dst FROM e), seeds AS ({SLICE_SEEDS}),
    w AS (SELECT node AS seed, node, 0 AS depth FROM seeds UNION SELECT w.seed, u.dst, w.depth + 1 FROM w JOIN u ON u.src = w.node WHERE w.depth < 2),
    d AS (SELECT seed, node, min(depth) AS depth FROM w GROUP BY ALL), k AS (SELECT d.seed, e.src, e.dst, t.depth <= d.depth AS closes FROM d JOIN e ON e.src = d.node JOIN d t ON t.seed = d.seed AND t.node = e.dst WHERE d.depth < 2),
    n AS (SELECT seed, count(*) AS n_nodes, bool_or(depth = 2 AND node IN (SELECT src FROM u)) AS truncated FROM d GROUP BY seed)
    SELECT seed, n_nodes, coalesce(x.n_edges, 0) AS n_edges, coalesce(x.n_closing, 0) AS n_closing, truncated FROM n LEFT JOIN (SELECT seed, count(*) AS n_edges, count(*) FILTER (WHERE closes) AS n_closing FROM k GROUP BY seed) x USING (seed)"""
)
def graph_slices(spark, folder):
    """Two steps from every tenth customer: nodes, edges with parallel ones, and whether more follows."""
    seeds = sources.table(spark, folder, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    found, told = flows.slices(edges(spark, folder), seeds, 2, ("CALLS", "IMPORTS"))
    closing = found.groupBy("seed").agg(F.count_if("closes").alias("n_closing"))
    return told.join(closing, "seed", "left").na.fill(0, ["n_closing"]).select("seed", "n_nodes", "n_edges", "n_closing", "truncated")


TIERS = "SELECT o_custkey AS request, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS tier, concat('o', o_orderkey * 2) AS id FROM orders"


@query(f"WITH t AS ({TIERS}), k AS (SELECT DISTINCT * FROM t WHERE id IN (SELECT concat('o', o_orderkey) FROM orders)), b AS (SELECT *, min(tier) OVER (PARTITION BY request) AS best, row_number() OVER (PARTITION BY request, tier ORDER BY id) AS place FROM k) SELECT request, tier, id FROM b WHERE tier = best AND (tier < 2 OR place <= 1)")
def code_entry_cascade(spark, folder):
    """Per customer the first kind of orders that leads to a known one; of the last kind one only."""
    orders = sources.table(spark, folder, "orders")
    tier = F.expr("CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END")
    asked = orders.select(F.col("o_custkey").alias("request"), tier.alias("tier"), F.concat(F.lit("o"), (F.col("o_orderkey") * 2).cast("string")).alias("id"))
    return flows.entry_cascade(asked, orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node")), {2: 1})


@query()
def graph_modularity(spark, folder):
    """Communities of brands and types of parts that go together."""
    pairs = sources.table(spark, folder, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"))
    labels, value = modularity.communities(pairs)
    return labels.select("node", "community", F.round(F.lit(value), 6).alias("modularity"))


HINTS = [("lib0", "r0"), ("lib1", "r1"), ("lib2", "r2"), ("lib2.m7", "r0"), ("lib3", "gone")]
FILES = "SELECT DISTINCT concat('r', p_partkey % 3) AS repo, concat('lib', p_partkey % 3, '/m', p_partkey % 500, '.py') AS path FROM part"
ASKED = "SELECT concat('r', p_partkey % 3, '::file:lib', p_partkey % 3, '/m', p_partkey % 500, '.py') AS src, concat('r', p_partkey % 3) AS repo, concat('lib', (p_partkey + p_size) % 4, '.m', (p_partkey * 7) % 800) AS module FROM part"


@query(
    f"""WITH h(prefix, target) AS (VALUES {", ".join(map(str, HINTS))}), f AS ({FILES}), a AS (SELECT DISTINCT * FROM ({ASKED})), m AS (SELECT a.*, arg_max(target, length(prefix)) AS target, max(length(prefix)) AS size FROM a JOIN h ON module = prefix OR starts_with(module, prefix || '.') GROUP BY ALL)
    SELECT src, concat(target, '::file:', path) AS dst, 0.85::DOUBLE AS confidence, concat(m.repo, '::external::', module) AS resolved_from FROM m JOIN f ON f.repo = m.target AND f.path = concat(replace(module, '.', '/'), '.py') WHERE target <> m.repo"""
)
def code_cross_repo(spark, folder):
    """Imports that lead into another repository, by the longest hint."""
    part = sources.table(spark, folder, "part")
    repo = F.concat(F.lit("r"), F.col("p_partkey") % 3)
    own = F.expr("concat('r', p_partkey % 3, '::file:lib', p_partkey % 3, '/m', p_partkey % 500, '.py')")
    nodes = part.select(own.alias("id"), repo.alias("repo"), F.lit("python").alias("language")).distinct()
    module = F.expr("concat('lib', (p_partkey + p_size) % 4, '.m', (p_partkey * 7) % 800)")
    asked = part.select(own.alias("src"), F.concat(repo, F.lit("::external::"), module).alias("dst"), F.lit("IMPORTS").alias("relation"), F.lit(0.8).alias("confidence"))
    found = codegraph.cross_repo_imports(nodes, asked, spark.createDataFrame(HINTS, "prefix string, repo string"))
    return found.select("src", "dst", "confidence", "resolved_from")
