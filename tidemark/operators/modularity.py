"""Communities of a graph by modularity: local moves, then the same over the graph of communities, level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.graph import reversed_edges
from tidemark.storage import stored

#: Less is no gain.
LEAST_GAIN = 1e-9
#: Passes without a rise of modularity, one after another, that end a level: both halves of the nodes have had their turn twice.
IDLE = 4


@dataclass
class _Pass:
    """A row a node, and the modularity of its labels: (node, k, community, inner, best), ``inner`` its weights inside its community, ``best`` its best move."""

    rows: DataFrame
    modularity: float
    gainers: int


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, w): each pair that any edge joins, both ways, once; loops are no links."""
    pairs = edges.select("src", "dst").where("src <> dst")
    return pairs.unionByName(reversed_edges(pairs)).distinct().withColumn("w", F.lit(1.0))


def _measured(links: DataFrame, labels: DataFrame, two_m: float) -> _Pass:
    """The state of (node, k, community), k the sum of a node's weights.

    A pass is one plan that writes a row a node and one sum over these rows: nearly all the time of a small graph goes into
    starting jobs. Written tables have a known size, so that small ones are broadcast.
    """
    totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
    ends = links.join(labels.select(F.col("node").alias("dst"), "community"), "dst")
    weights = ends.groupBy("src", "community").agg(F.sum(F.when(F.col("src") != F.col("dst"), F.col("w")).otherwise(0.0)).alias("w"), F.sum("w").alias("all_w"))
    own = labels.join(totals, "community").select(F.col("node").alias("src"), F.col("community").alias("own"), "k", F.col("total").alias("own_total"))
    inside = F.col("community") == F.col("own")
    own_w = F.coalesce(F.max(F.when(inside, F.col("w"))).over(Window.partitionBy("src")), F.lit(0.0))
    around = weights.join(own, "src").join(totals, "community").withColumn("own_w", own_w)
    gain = 2 * (F.col("w") - F.col("own_w")) / two_m - 2 * F.col("k") * (F.col("total") - F.col("own_total") + F.col("k")) / two_m**2
    better = F.when(~inside & (F.col("gain") > LEAST_GAIN), F.struct((-F.col("gain")).alias("loss"), "community"))
    rows = around.withColumn("gain", gain).groupBy(F.col("src").alias("node")).agg(F.first("k").alias("k"), F.first("own").alias("community"), F.sum(F.when(inside, F.col("all_w")).otherwise(0.0)).alias("inner"), F.min(better).alias("best"))
    rows = stored(rows, "modularity-pass")
    sums = rows.groupBy("community").agg(F.sum("k").alias("total"), F.sum("inner").alias("inner"), F.count("best").alias("gainers"))
    got = sums.agg(F.sum("inner").alias("inner"), F.sum(F.col("total") * F.col("total")).alias("square"), F.sum("gainers").alias("gainers")).first()
    return _Pass(rows, (got["inner"] or 0.0) / two_m - (got["square"] or 0.0) / two_m**2, got["gainers"] or 0)


def _moved(state: _Pass, turn: int, two_m: float) -> DataFrame:
    """(node, k, community) after the moves of one half of the nodes.

    A node moves to where it gains most, the smaller name of equals. Of nodes that go to one community each counts those before
    it, so that many may join at once.
    """
    mine = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
    asked = state.rows.select("node", "k", "community", F.when(mine, F.col("best.community")).alias("to"), (-F.col("best.loss")).alias("gain"))
    # Nodes that don't ask to move are groups of their own.
    before = Window.partitionBy("to", F.when(F.col("to").isNull(), F.col("node"))).orderBy(F.desc("gain"), "node").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.col("gain") - 2 * F.col("k") * F.coalesce(F.sum("k").over(before), F.lit(0.0)) / two_m**2 > LEAST_GAIN
    return asked.withColumn("sure", sure).select("node", "k", F.when(F.col("to").isNotNull() & F.col("sure"), F.col("to")).otherwise(F.col("community")).alias("community"))


def _level(links: DataFrame, labels: DataFrame, two_m: float, passes: int) -> _Pass:
    """Moves until no node gains, or ``passes`` are done; moves that don't raise the modularity are taken back."""
    state, idle = _measured(links, labels, two_m), 0
    for turn in range(passes):
        if not state.gainers:
            break
        tried = _measured(links, _moved(state, turn, two_m), two_m)
        if tried.modularity > state.modularity + LEAST_GAIN:
            state, idle = tried, 0
        else:
            idle += 1
            if idle == IDLE:
                break
    return state


def _with_degrees(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, k, community) of the labels (node, community) of nodes that have links."""
    return stored(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).join(labels, "node").select("node", "k", "community"), "modularity-labels")


def communities(edges: DataFrame, passes: int = 40, levels: int = 10) -> tuple[DataFrame, float]:
    """(node, community) of the nodes of edges (src, dst) that lead to another one, and the modularity that they reach.

    Edges count as undirected and parallel ones once. A community is named by its smallest node. Each level moves single nodes (then
    communities of the level below) for at most ``passes`` passes and hands its communities on as the nodes of the next; it ends
    when nothing is merged any more. Modularity never falls, and ties and halves are fixed, so that results don't depend on the order of rows.
    """
    links = stored(undirected(edges), "modularity-links")
    two_m = links.agg(F.sum("w")).first()[0]
    nodes = links.select(F.col("src").alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("community"))
    if not two_m:
        return labels, 0.0
    value = None
    for _ in range(levels):
        own = links.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("community"))
        state = _level(links, _with_degrees(links, own), two_m, passes)
        value = state.modularity
        names = stored(state.rows.withColumn("name", F.min("node").over(Window.partitionBy("community"))).select("node", "name"), "modularity-names")
        labels = stored(labels.join(names.withColumnRenamed("node", "community"), "community").select("node", F.col("name").alias("community")), "modularity-communities")
        if names.where("node <> name").isEmpty():
            break
        side = lambda end: names.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"))
        links = stored(links.join(side("src"), "src").join(side("dst"), "dst").groupBy(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")).agg(F.sum("w").alias("w")), "modularity-links")
    return labels, value


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """The modularity of (node, community) over edges (src, dst), undirected, parallel ones once."""
    links = undirected(edges)
    two_m = links.agg(F.sum("w")).first()[0]
    return _measured(links, _with_degrees(links, labels), two_m).modularity if two_m else 0.0
