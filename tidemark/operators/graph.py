"""Labelled multigraphs as vertex and edge tables: (src, dst, relation)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import spread
from tidemark.storage import bucketed, cut, discard, stored


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


def simple(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Parallel edges as one; an edge without a relation counts as CALLS, and CONTAINS is left out unless asked for."""
    named = F.coalesce("relation", F.lit("CALLS"))
    kept = edges.where(named.isin(relations) if relations else named != "CONTAINS")
    return kept.select("src", "dst").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """(seed, node, depth) of all nodes at most ``depth`` edges from each seed of (node), by the shortest way; None sets no limit."""
    return _walk(edges, seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct(), depth)


def _walk(edges: DataFrame, seen: DataFrame, depth: int | None) -> DataFrame:
    step = cut(edges.select("src", "dst").distinct())  # every level reads it
    front = seen
    for k in count(1) if depth is None else range(1, depth + 1):
        around = front.join(step, front["node"] == step["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = cut(around.join(seen, ["seed", "node"], "left_anti").select("seed", "node", F.lit(k).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if k % 16 == 0:
            seen = cut(seen)  # or the plan grows with each step
    return seen


def descendants(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that a change of each seed reaches; the seed itself is not among them."""
    return reach(edges, seeds, depth).where("node <> seed")


#: Seeds in a number of a mask.
_BITS = 62


def reach_counts(edges: DataFrame, seeds: list[str]) -> dict[str, int]:
    """How many other nodes each of a few hundred seeds reaches.

    A node carries one mask of the seeds that reach it, which is or-ed along the edges until no bit is new: a row a node, whatever the number of seeds.
    Only seeds and nodes that something leads to hand a mask on; edges from other nodes are left behind before the first round.
    """
    spark, masks = edges.sparkSession, [f"m{k}" for k in range(-(-len(seeds) // _BITS))]
    if not seeds:
        return {}
    links = edges.select("src", "dst").where("src <> dst")
    led = links.select(F.col("dst").alias("src")).union(spark.createDataFrame([(seed,) for seed in seeds], "src string")).distinct()
    # The nodes are hashed, so that the edges are not sorted.
    step = cut(links.join(led.hint("shuffle_hash"), "src", "left_semi").distinct())
    start = [(seed, *[1 << at % _BITS if at // _BITS == k else 0 for k in range(len(masks))]) for at, seed in enumerate(seeds)]
    seen = front = cut(spark.createDataFrame(start, ", ".join(["node string", *[f"{m} long" for m in masks]])))
    while not front.isEmpty():
        flow = front.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(*[F.bit_or(m).alias(m) for m in masks])
        known = seen.select("node", *[F.col(m).alias(f"old_{m}") for m in masks])
        fresh = flow.join(known, "node", "left").select("node", *[F.col(m).bitwiseAND(F.bitwise_not(F.coalesce(f"old_{m}", F.lit(0).cast("long")))).alias(m) for m in masks])
        front = cut(fresh.where(" OR ".join(f"{m} <> 0" for m in masks)))
        seen = cut(seen.unionByName(front).groupBy("node").agg(*[F.bit_or(m).alias(m) for m in masks]))
    counts = seen.agg(*[F.sum(F.shiftright(F.col(masks[at // _BITS]), at % _BITS).bitwiseAND(F.lit(1).cast("long"))).alias(f"n{at}") for at in range(len(seeds))]).first()
    return {seed: counts[at] - 1 for at, seed in enumerate(seeds)}


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def ancestors(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that reach each seed; the seed itself is not among them."""
    return descendants(reversed_edges(edges), seeds, depth)


def impact(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth) of the seeds and all that any of them reaches: one walk for all seeds, not one each."""
    return _walk(edges, seeds.select(F.lit(0).alias("seed"), "node", F.lit(0).alias("depth")).distinct(), depth).select("node", "depth")


def neighbourhood(edges: DataFrame, start: str, depth: int, cap: int) -> DataFrame:
    """(node, depth) around ``start``, either way along edges, level by level.

    A level is taken in the order of its nodes until ``cap`` nodes are found. A depth of 0 or less
    sets no limit of levels; an unknown start finds nothing.
    """
    pairs = edges.select("src", "dst")
    both = cut(pairs.unionByName(reversed_edges(pairs)).distinct())
    seen = cut(both.where(F.col("src") == start).select(F.col("src").alias("node"), F.lit(0).alias("depth")).limit(1))
    front, found, k = seen, seen.count(), 0
    while 0 < found < cap and (k < depth or depth <= 0):
        k += 1
        near = front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(near.orderBy("node").limit(cap - found).select("node", F.lit(k).alias("depth")))
        more = front.count()
        if not more:
            break
        seen, found = seen.unionByName(front), found + more
    return seen


def communities(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """(node, community) by label propagation, a community named by one of its nodes.

    In each round a node takes the label that most of its parallel edges lead to, its own counting
    once, and the smaller of equals, so that results don't depend on the order of rows.
    """
    pairs = edges.select("src", "dst").where("src <> dst")
    both = pairs.unionByName(reversed_edges(pairs))
    n = spread.tasks(pairs, 2 * pairs.count())
    # Every round reads the links by dst, so that they are written in buckets of it and never shuffled again.
    links = bucketed(both.repartition(n, "dst").groupBy("dst", "src").agg(F.count("*").alias("weight")), "community-links", n, "dst")
    labels = links.select(F.col("dst").alias("node"), F.col("dst").alias("community")).distinct()
    for k in range(rounds):
        if k:
            last = labels
            around = links.join(labels.repartition(n, "node").hint("shuffle_hash"), F.col("dst") == F.col("node")).select("src", "community", "weight")
            told = around.unionByName(labels.select(F.col("node").alias("src"), "community", F.lit(1).cast("long").alias("weight")))
            # The votes of a node meet by parts first, so that no task has all of a node with very many links.
            parts = told.withColumn("salt", spread.salt("community")).repartition(n, "src", "salt")
            votes = parts.groupBy("src", "salt", "community").agg(F.sum("weight").alias("votes"))
            best = votes.groupBy("src", "salt").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "community")).alias("best"))
            labels = stored(best.repartition(n, "src").groupBy(F.col("src").alias("node")).agg(F.min("best")["community"].alias("community")), "community-labels")
            discard(last)
        else:
            # As yet each link is the only one that leads to its label.
            own = F.struct(F.lit(-1).cast("long").alias("votes"), F.col("dst").alias("community"))
            best = F.least(F.min(F.struct((-F.col("weight")).alias("votes"), F.col("src").alias("community"))), own)
            labels = stored(links.groupBy("dst").agg(best.alias("best")).select(F.col("dst").alias("node"), F.col("best.community").alias("community")), "community-labels")
    if rounds:
        discard(links)
    return labels


def community_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges inside each community of (node, community), by relation, and the share of calls."""
    a = labels.select(F.col("node").alias("src"), F.col("community"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("other"))
    inside = edges.join(a, "src").join(b, "dst").where("community = other")
    calls, imports = F.count_if(F.col("relation") == "CALLS"), F.count_if(F.col("relation") == "IMPORTS")
    return inside.groupBy("community").agg(F.count("*").alias("n"), calls.alias("n_calls"), imports.alias("n_imports"), F.round(calls / F.count("*"), 6).alias("calls_share"))


def hot_paths(found: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` paths with the highest scores, ties by path."""
    return found.orderBy(F.desc("score"), "path").limit(n)


def common_prefix(rows: DataFrame, group: str, path: str) -> DataFrame:
    """(group, prefix, n): the whole leading segments that all paths of a group share.

    What the least and the greatest path share is shared by all between them, so that two values a group do.
    """
    parts = F.split(path, "/")
    ends = rows.groupBy(group).agg(F.min(parts).alias("low"), F.max(parts).alias("high"), F.count(path).alias("n"))
    lengths = F.sequence(F.lit(0), F.least(F.size("low"), F.size("high")))
    longest = F.array_max(F.filter(lengths, lambda k: F.slice("low", F.lit(1), k) == F.slice("high", F.lit(1), k)))
    return ends.select(group, F.array_join(F.slice("low", F.lit(1), longest), "/").alias("prefix"), "n")


def shared_references(endpoints: DataFrame) -> DataFrame:
    """(src, dst) where a response of one endpoint holds a type that a request of another asks for.

    Over (endpoint, responses, requests); the arrays are exploded and joined by equality.
    """
    given = endpoints.select(F.col("endpoint").alias("src"), F.explode(F.array_distinct("responses")).alias("ref"))
    asked = endpoints.select(F.col("endpoint").alias("dst"), F.explode(F.array_distinct("requests")).alias("ref"))
    return given.join(asked, "ref").where("src <> dst").select("src", "dst").distinct()


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """(line): each edge of (src, dst, relation) as an arrow with a label, for a flow chart."""
    name = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return edges.select(F.concat(F.lit("  "), name("src"), F.lit(" -->|"), F.coalesce("relation", F.lit("CALLS")), F.lit("| "), name("dst")).alias("line")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def top_degree(edges: DataFrame, n: int, among: DataFrame | None = None) -> DataFrame:
    """(node, out_degree): the ``n`` nodes that most edges leave; of those of ``among`` (node), if given, which meet the counts and not the edges."""
    degrees = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    kept = degrees if among is None else degrees.join(among.select("node").distinct(), "node", "left_semi")
    return kept.orderBy(F.desc("out_degree"), "node").limit(n)


def edge_shares(edges: DataFrame, rare: float = 0.05) -> DataFrame:
    """From (src, dst, n): the share of all, the share of what leaves src, and whether it is rare."""
    total = edges.agg(F.sum("n").alias("total"))
    out = edges.groupBy("src").agg(F.sum("n").alias("leaving"))
    share = F.col("n") / F.greatest("total", F.lit(1))
    # The total is one row, and is sent with the plan.
    return edges.join(out, "src").crossJoin(F.broadcast(total)).select("src", "dst", "n", F.round(share, 6).alias("share"), F.round(F.col("n") / F.col("leaving"), 6).alias("probability"), (share < rare).alias("rare"))


def paths(edges: DataFrame, start: str, end: str, depth: int) -> DataFrame:
    """(path, probability, count) of all paths of distinct nodes from start to end over (src, dst, n, probability)."""
    step = edges.select("src", "dst", F.col("n").alias("step_n"), F.col("probability").alias("p"))
    front = step.sparkSession.createDataFrame([([start], 0.0, 0)], "nodes array<string>, log_p double, total long")
    done = []
    for _ in range(depth):
        last = F.element_at("nodes", -1)
        longer = front.withColumn("at", last).join(step, F.col("at") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        p = F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-12))
        longer = longer.select(F.concat("nodes", F.array("dst")).alias("nodes"), (F.col("log_p") + F.ln(p)).alias("log_p"), (F.col("total") + F.col("step_n")).alias("total"))
        done.append(longer.where(F.element_at("nodes", -1) == end))
        front = longer.where(F.element_at("nodes", -1) != end)
    found = reduce(DataFrame.unionByName, done)
    return found.select(F.array_join("nodes", ">").alias("path"), F.round(F.exp("log_p"), 6).alias("probability"), F.col("total").alias("score"))


def merged(edges: DataFrame, *flags: str) -> DataFrame:
    """Parallel edges of a relation as one: all conditions, the least confidence, how many, and of each flag whether any edge has it."""
    any_of = [F.bool_or(f).alias(f) for f in flags]
    return edges.groupBy("src", "dst", "relation").agg(F.array_join(F.array_sort(F.collect_set("condition")), "|").alias("conditions"), F.min("confidence").alias("confidence"), F.count("*").alias("n"), *any_of)


def upsert(stored: DataFrame, scan: DataFrame, scan_id: int, keys: list[str]) -> DataFrame:
    """A scan over a store: known rows keep their first scan, rows that the scan lacks go."""
    known = stored.select(*keys, "first_seen")
    return scan.join(known, keys, "left").select(*scan.columns, F.coalesce("first_seen", F.lit(scan_id)).alias("first_seen"), F.lit(scan_id).alias("last_seen"))


def match(vertices: DataFrame, edges: DataFrame, relations: list[str], name: str) -> DataFrame:
    """(a)-[relations]->(b) where a has the name: edges with both ends' names."""
    a = vertices.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = vertices.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return edges.where(F.col("relation").isin(relations)).join(a.where(F.col("src_name") == name), "src").join(b, "dst").select("src", "dst", "relation", "src_name", "dst_name")


def transitions(events: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """(src, dst, n) of consecutive states in each group."""
    window = Window.partitionBy(by).orderBy(*order)
    pairs = events.select(F.col(state).alias("src"), F.lead(state).over(window).alias("dst")).where("dst IS NOT NULL")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch any of ``nodes`` (node) at either end: two equi-joins, for an OR of both can't be hashed."""
    ids = nodes.select("node").distinct()
    left = edges.join(ids, edges["src"] == ids["node"], "left_semi")
    return left.unionByName(edges.join(ids, edges["dst"] == ids["node"], "left_semi")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("node").distinct()
    return edges.join(ids, edges["src"] == ids["node"], "left_semi").join(ids, F.col("dst") == ids["node"], "left_semi")


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smaller of equals, with its share."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.max(F.struct(F.col("n"), F.lit(0).alias("x"))).alias("top"), F.sum("n").alias("total"))
    tied = counts.join(best, group).where(F.col("n") == F.col("top.n"))
    return tied.groupBy(group).agg(F.min(value).alias(value), F.first("n").alias("n"), F.round(F.first(F.col("n") / F.col("total")), 6).alias("share"))


def ego(edges: DataFrame, center: DataFrame) -> DataFrame:
    """(center, src, dst) of the edges that touch each center, by two equi-joins."""
    ids = center.select(F.col("node").alias("center")).distinct()
    out = edges.join(ids, F.col("src") == F.col("center")).select("center", "src", "dst")
    return out.unionByName(edges.join(ids, F.col("dst") == F.col("center")).select("center", "src", "dst")).distinct()
