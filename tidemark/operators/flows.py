"""Control-flow graphs as tables: paths with their probabilities, bounded slices, and the entries that a scan starts from.

Many graphs are walked at once: each row says which one it belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.graph import reach
from tidemark.storage import cut, stored

# Kinds of nodes whose visits count, and labels of edges that leave a loop.
LOOPS = ("LOOP_HDR", "LOOP")
EXITS = ("exit", "false", "break", "no_else")


def _sorted(frame: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and sorted whatever its size: each level of a walk would send it through the driver else."""
    return frame.hint("merge")


def _clamped(p: Column | float) -> Column:
    return F.greatest(F.least(F.lit(p) if isinstance(p, float) else p, F.lit(1.0)), F.lit(1e-12))


def edge_probabilities(nodes: DataFrame, edges: DataFrame, if_branch: float = 0.5, loop_repeat: float = 0.6) -> DataFrame:
    """``edges`` (graph, src, dst, label, place, measured) with p: as measured, or else by the kind of their source and their label.

    Then and else of an IF take ``if_branch``, repeat and exit of a LOOP_HDR ``loop_repeat`` and the rest, a SWITCH shares alike; all else is sure.
    """
    kinds = nodes.select("graph", F.col("node").alias("src"), F.col("kind").alias("src_kind"))
    leaving = F.count("*").over(Window.partitionBy("graph", "src"))
    label, kind = F.lower(F.coalesce("label", F.lit(""))), F.col("src_kind")
    by_kind = (
        F.when((kind == "IF") & label.isin("then", "else"), _clamped(if_branch))
        .when((kind == "LOOP_HDR") & (label == "repeat"), _clamped(loop_repeat))
        .when((kind == "LOOP_HDR") & (label == "exit"), _clamped(1.0 - loop_repeat))
        .when(kind == "SWITCH", 1.0 / F.col("leaving"))
        .otherwise(1.0)
    )
    wide = edges.withColumn("leaving", leaving).join(_sorted(kinds), ["graph", "src"], "left")
    return wide.withColumn("p", F.when(F.col("measured").isNotNull(), _clamped(F.col("measured").cast("double"))).otherwise(by_kind)).drop("leaving", "src_kind")


def control_paths(nodes: DataFrame, edges: DataFrame, max_paths: int = 100, max_depth: int = 1000, max_visits: int = 2, if_branch: float = 0.5, loop_repeat: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Paths from START to END: (graph, rank, path, probability), and of each graph (graph, truncated).

    ``nodes``: (graph, node, kind), with one START and one END a graph; ``edges``: (graph, src, dst, label, place, measured), ``place``
    the order of the edges that leave a node. From its visit number ``max_visits`` + 1 on, a loop's header leads on by exits
    only. Of a graph's paths the first ``max_paths`` count, in the order of the places along them; ``truncated`` says whether
    branches were given up, for that or for ``max_depth`` edges. A step's probability is that of the first edge between its nodes.

    The walk goes level by level over all graphs. A branch whose node can leave all loops and reach the end has a path
    for sure, so that branches behind ``max_paths`` sure ones are given up: that many are held a graph, besides those that may lead nowhere.
    """
    told = edge_probabilities(nodes, edges, if_branch, loop_repeat)
    first = F.min_by("p", "place").over(Window.partitionBy("graph", "src", "dst"))
    kinds = nodes.select("graph", F.col("node").alias("src"), F.col("kind").isin(*LOOPS).alias("loops"))
    steps = told.withColumn("p", first).join(_sorted(kinds), ["graph", "src"], "left")
    exits = F.lower(F.coalesce("label", F.lit(""))).isin(*EXITS)
    steps = steps.select("graph", "src", "dst", "place", "p", F.coalesce("loops", F.lit(False)).alias("loops"), exits.alias("exits"))
    ends = nodes.where("kind = 'END'").select("graph", F.col("node").alias("dst"))
    steps = stored(steps.join(_sorted(ends.withColumn("is_end", F.lit(True))), ["graph", "dst"], "left").na.fill(False, ["is_end"]), "flow-steps")

    sure = stored(_leaving(steps, ends, max_depth), "sure-nodes")
    front = nodes.where("kind = 'START'").select("graph", F.col("node").alias("at"), F.array("node").alias("path"), F.array().cast("array<int>").alias("places"), F.lit(1.0).alias("p"))
    at_end = ends.select("graph", F.col("dst").alias("at"), F.lit(True).alias("done"))
    front = front.join(_sorted(at_end), ["graph", "at"], "left").na.fill(False, ["done"])
    given_up = None
    for depth in range(max_depth + 2):
        ranked = front.join(_sorted(sure), ["graph", "at"], "left").withColumn("counts", F.when(F.col("done"), F.size("places") <= max_depth).otherwise(F.coalesce(F.col("far") + depth <= max_depth, F.lit(False))).cast("int"))
        before = Window.partitionBy("graph").orderBy("places").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("kept", F.coalesce(F.sum("counts").over(before), F.lit(0)) < max_paths)
        ranked = cut(ranked.withColumn("kept", F.col("kept") & (F.size("places") <= max_depth)).drop("far", "counts"))
        lost = ranked.where("NOT kept").select("graph").distinct()
        given_up = lost if given_up is None else given_up.union(lost)
        front = ranked.where("kept").drop("kept")
        live = front.where("NOT done")
        if live.isEmpty():
            break
        visits = F.size(F.filter("path", lambda n: n == F.col("at")))
        longer = live.withColumnRenamed("p", "so_far").drop("done").join(_sorted(steps.withColumnRenamed("src", "at")), ["graph", "at"]).where(~F.col("loops") | (visits <= max_visits) | F.col("exits"))
        longer = longer.select("graph", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("places", F.array("place")).alias("places"), (F.col("so_far") * F.col("p")).alias("p"), F.col("is_end").alias("done"))
        front = front.where("done").unionByName(longer)
        if depth % 16 == 15:
            given_up = cut(given_up.distinct())
    place = F.row_number().over(Window.partitionBy("graph").orderBy("places"))
    paths = front.where("done").withColumn("rank", place).where(F.col("rank") <= max_paths).select("graph", "rank", "path", F.col("p").alias("probability"))
    whole = nodes.select("graph").distinct().join(_sorted(given_up.distinct().withColumn("truncated", F.lit(True))), "graph", "left").na.fill(False, ["truncated"])
    return paths, whole


def _leaving(steps: DataFrame, ends: DataFrame, max_depth: int) -> DataFrame:
    """(graph, at, far): nodes from which the end is reached with every loop left at its header, and by how many edges at least."""
    back = steps.where("NOT loops OR exits").select("graph", F.col("src").alias("before"), F.col("dst").alias("at")).distinct()
    seen = ends.select("graph", F.col("dst").alias("at"), F.lit(0).alias("far"))
    front = seen
    for far in range(1, max_depth + 1):
        near = front.join(_sorted(back), ["graph", "at"]).select("graph", F.col("before").alias("at")).distinct()
        front = cut(near.join(_sorted(seen), ["graph", "at"], "left_anti").withColumn("far", F.lit(far)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if far % 16 == 0:
            seen = cut(seen)
    return seen


def slices(edges: DataFrame, seeds: DataFrame, depth: int, relations: tuple[str, ...] = ("CALLS",)) -> tuple[DataFrame, DataFrame]:
    """What seeds of (node) reach in at most ``depth`` steps: (seed, src, dst, relation, closes) edges, and (seed, n_nodes, n_edges, truncated).

    Edges of (src, dst, relation) count with one of the relations, one without as CALLS, parallel ones each. They are those that leave nodes before the
    last level; ``closes`` marks a target no deeper than its source, which a cycle needs. ``truncated``: a node of the last level leads on.
    """
    named = edges.withColumn("relation", F.coalesce("relation", F.lit("CALLS"))).where(F.col("relation").isin(*relations)).select("src", "dst", "relation")
    found = stored(reach(named, seeds.select("node").distinct(), depth), "slice-nodes")
    inner = found.where(F.col("depth") < depth).select("seed", F.col("node").alias("src"), F.col("depth").alias("from_depth"))
    ends = found.select("seed", F.col("node").alias("dst"), F.col("depth").alias("to_depth"))
    cut_edges = stored(named.join(inner, "src").join(ends, ["seed", "dst"]).select("seed", "src", "dst", "relation", (F.col("to_depth") <= F.col("from_depth")).alias("closes")), "slice-edges")
    last = found.where(F.col("depth") == depth).select("seed", F.col("node").alias("src"))
    more = last.join(named.select("src").distinct(), "src").select("seed").distinct().withColumn("truncated", F.lit(True))
    sizes = found.groupBy("seed").agg(F.count("*").alias("n_nodes"))
    n_edges = cut_edges.groupBy("seed").agg(F.count("*").alias("n_edges"))
    told = sizes.join(n_edges, "seed", "left").join(more, "seed", "left").na.fill(0, ["n_edges"]).na.fill(False, ["truncated"])
    return cut_edges, told


def entry_cascade(candidates: DataFrame, nodes: DataFrame, caps: dict[int, int] | None = None) -> DataFrame:
    """(request, tier, id): of each request's candidates (request, tier, id) that the graph has those of the first tier that has any.

    Tiers come in order, from what was asked for to what stands in where nothing else is found; ``caps`` keeps of a tier's ids
    the first so many. A request none of whose candidates is in the graph has no rows.
    """
    known = candidates.select("request", "tier", "id").distinct().join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    best = known.groupBy("request").agg(F.min("tier").alias("tier"))
    return _capped(known.join(best, ["request", "tier"]), caps or {})


def _capped(chosen: DataFrame, caps: dict[int, int]) -> DataFrame:
    limit = F.lit(None).cast("int")
    for tier, most in caps.items():
        limit = F.when(F.col("tier") == tier, most).otherwise(limit)
    place = F.row_number().over(Window.partitionBy("request").orderBy("id"))
    return chosen.withColumn("place", place).withColumn("most", limit).where("most IS NULL OR place <= most").select("request", "tier", "id")
