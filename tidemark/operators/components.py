"""Connected components of an undirected graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import spread
from tidemark.storage import discard, stored

#: Edges that a task links at once, and the share of them above which it hands on their nodes.
CHUNK, FULL = 1 << 19, 1 / 2


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its smallest node.

    Each task first links the edges it has, and hands on a row a node: the least node it knows it to be linked with.  In a round all
    rows of a node meet; the nodes that were found in their place are linked with the least of them, and a node that no other one was
    linked with hangs on that and is done, so that what goes on to the next round are the tasks' least nodes.  Where a round
    doesn't halve the links, as along a chain, a large-star step follows, which halves distances.  Nodes that hang get their names
    in the end, from the last round to the first.  Null ends and loops carry no edge; a node with a loop only is its own component.
    Tasks are as many as the rows ask for; a node has at most a row from each chunk of edges, and rows that hang on one node don't meet in one task.
    """
    given = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.lit(False).alias("hung"))
    graph = table = stored(_linked(given), "components-linked")
    rows, links = _size(graph)
    levels = []
    while links:
        table, last = stored(_linked(_round(graph, spread.tasks(graph, rows))), "components-round"), table
        levels.append((table, rows))
        if len(levels) == 1:
            discard(last)
        graph, before = table.where("NOT hung"), links
        rows, links = _size(graph)
        if 2 * links > before:
            graph = _large_star(graph, spread.tasks(graph, 2 * links))
            rows, links = _size(graph)
    labels = graph.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()  # where no round was needed, several tasks may tell of one node
    for k, (table, rows) in reversed([*enumerate(levels)]):
        labels = labels.unionByName(_named(table.where("hung"), labels, spread.tasks(table, rows)))
        if k:
            labels = stored(labels, "components-labels")
    return labels


def _linked(rows: DataFrame) -> DataFrame:
    """The edges (u, v) of each task as rows (node, least node it is linked with in the task), which each node has, itself linked with itself; rows that hang stay as they are."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            hung = batch.column(2)
            if pc.any(hung).as_py():
                yield batch.filter(hung)
                batch = batch.filter(pc.invert(hung))
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                met = _stars(held)
                held, n = [met], met.num_rows
                if n > CHUNK * FULL:
                    yield met
                    held, n = [], 0
        if n:
            yield _stars(held)

    return rows.mapInArrow(link, rows.schema)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = pa.concat_arrays([b.column(k) for k in (0, 1) for b in batches]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    nodes, rank = ends.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    u, v = rank[ends.indices.to_numpy()].reshape(2, -1)
    return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(least_linked(u, v, len(nodes)))), pa.repeat(False, len(nodes))], schema=batches[0].schema)


def least_linked(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` nodes the least one that the edges between ``u`` and ``v`` link it with, itself included."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((above := label[label]) != label).any():
            label = above


def _round(graph: DataFrame, n: int) -> DataFrame:
    """What goes on, and the rows that hang."""
    node = Window.partitionBy("u")
    whole = node.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = graph.repartition(n, "u").select("u", "v", F.min("v").over(whole).alias("m"), (F.max("v").over(whole) == F.col("u")).alias("least"), F.row_number().over(node.orderBy("v")).alias("place"))
    # A node that is the least one of some task has itself among its rows, and so goes on, alone if it is the least of all.
    own = (F.col("place") == 1) & (~F.col("least") | (F.col("u") == F.col("m")))
    hung = (F.col("v") == F.col("m")) & ~F.col("least")
    return told.select(F.when(F.col("v") != F.col("m"), F.col("v")).when(own, F.col("u")).alias("u"), F.col("m").alias("v"), hung.alias("hung")).where("u IS NOT NULL")


def _large_star(graph: DataFrame, n: int) -> DataFrame:
    """Neighbours above a node go to the smallest one around it."""
    pairs, lone = graph.where("u <> v"), graph.where("u = v")
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = stored(spread.least(both, "u", "v", n).select("u", F.least("u", "m").alias("m"), "n"), "components-least")
    large = spread.with_least(both.where("v > u"), around, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(False).alias("hung"))
    found = stored(_linked(large.unionByName(lone)), "components-large")
    discard(around)
    return found


def _named(hung: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(node, component) of nodes u that hang on nodes v of ``labels``."""
    sizes = hung.groupBy("v").agg(F.count("*").alias("n"))
    found = stored(labels.join(sizes, F.col("node") == F.col("v")).select("v", F.col("component").alias("m"), "n"), "components-found")
    return spread.with_least(hung.select("u", "v"), found, "v", n).select(F.col("u").alias("node"), F.col("m").alias("component"))


def _size(graph: DataFrame) -> tuple[int, int]:
    """How many rows and how many links there are."""
    got = graph.agg(F.count("*").alias("rows"), F.count_if(F.col("u") != F.col("v")).alias("links")).first()
    return got["rows"], got["links"]
