"""N-gram Jaccard self-join of documents, down to the components of its links.

Documents are rows of a sparse incidence matrix over n-gram columns; two of them link when the
overlap of their sets reaches a share of the union.  The matrix product is never formed whole:

* Equal sets are one row of the matrix, whatever the number of copies.
* Size-derived bounds deal rows into candidate clusters.  Sets of linked documents lie in the
  same or neighbouring size classes, and differ in at most ``d`` n-grams for a class.  Columns
  are cut into d + 1 + spare parts, so that linked sets agree on more than ``spare`` parts; a
  row sends one hash of each part that holds any of its n-grams.  Rows with a hash in common are
  joined to the first of them, never in pairs: first in the task, which hands on one row a hash, then
  over all tasks.
  The most common n-grams (``common_rows`` of them at most, counted over all documents) say
  little, so that they are left out of the parts at first.  Should all parts that agree be
  empty without them, then both rows have more than ``spare`` empty parts; such rows send
  the parts with the common n-grams, and the empty ones, too.  So no link is lost, whichever n-grams
  count as common.  Between tasks a hash and a set have 40 bits each beside the bucket; what falls together only so is compared in vain.
* Sets that share a passage can be joined to clusters that grow with the table though hardly any of them link. The sets of clusters that
  are larger than a block are dealt anew by prefixes: of linked sets each has more than ``percent`` of its n-grams in common with the other,
  so that they share one of those left, and one more, taken from the rarest on, in an order that is the same for all sets.
* A cluster's part of the product is computed in blocks of bounded rows and bytes a side.  Blocks of a
  large cluster hold sets of one size class, and meet blocks of the same and the neighbouring classes only.
  Overlap counts add up column by column: those that few rows hold as a sparse product, the others in slabs.
  Pairs whose sizes, or whose count with all columns to come, cannot reach the bound are discarded.  A
  block pair hands on a forest of its links, not all of them.

Each step is linear in rows of the tables, but for the block products inside a cluster, which are
dealt over the cluster as tasks of bounded size.  How many groups the shuffles have follows from the bytes in
the tables.  Nothing is capped.

Words: A-Z count as a-z, cut at white space.  Shingles: runs of ``size`` words; of fewer words
the whole sequence; of none the empty set, which links with nothing.  N-grams and sets stand
as 64-bit hashes.  Null text is empty.  A row of the input gives a row of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.samples import least_count
from tidemark.llm.wordhash import distinct, hash_texts, mix, shingles
from tidemark.llm.workers import trim, trimmed
from tidemark.operators.components import connected_components
from tidemark.storage import stored

_SALT = np.uint64(0xD6E8FEB86659FD93)
_PART = np.uint64(0xA0761D6478BD642F)
_CLASS = np.uint64(0xE7037ED1A0B428DB)
_EMPTY = np.uint64(0x8EBC6AF09C88C6E3)
_WHOLE = np.uint64(0x589965CC75374CC3)
#: Bits of the filter that is sent to all tasks: 8 MB, whatever the table's size.
FILTER_BITS = 1 << 26
#: Columns of the product that are added up at once, and pairs of the sparse product.
SLAB, PAIRS = 4096, 1 << 22
#: A column counts as dense from this share of all pairs of rows on.
DENSE = 1 / 32
#: Values of a group from which on its task trims its memory.
LARGE = 1 << 18
#: Bytes of a shuffle's group, and of a block of sets.
GROUP_BYTES, BLOCK_BYTES = 32 << 20, 8 << 20
#: Bits of a hash, and of a set's name, between tasks.
BITS = 40


def needed(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap that links two sets of ``total`` n-grams together."""
    return -(-percent * total // (100 + percent))


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, before, hashes in hash_texts(texts):
        for i in range(len(before) - 1):
            yield distinct(shingles(hashes[before[i] : before[i + 1]], size))


def set_id(found: np.ndarray) -> int | None:
    """A signed 64-bit hash of a whole set; null for the empty one."""
    if not len(found):
        return None
    total = mix(found ^ _SALT).sum(keepdims=True) + np.full(1, len(found), np.uint64) * _PART
    return int(mix(total).view(np.int64)[0])


class SizeClasses:
    """Classes of set sizes such that linked sets are at most one class apart."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self._grow()
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def _grow(self) -> None:
        self.starts.append(max(self.starts[-1] + 1, 100 * self.starts[-1] // self.percent + 1))

    def parts(self, k: int) -> tuple[int, int, int]:
        """Of class ``k`` and the one below: n-grams in which linked sets may differ, spare parts, all parts."""
        while len(self.starts) < k + 2:
            self._grow()
        differ = (100 - self.percent) * 2 * (self.starts[k + 1] - 1) // (100 + self.percent)
        spare = 2 + differ // 8
        return differ, spare, differ + 1 + spare


def signatures(found: np.ndarray, classes: SizeClasses, common: np.ndarray) -> np.ndarray:
    """Hashes of the parts of a sorted set, for its own class and the one above; ``common`` is sorted, too."""
    own, out = classes.of(len(found)), []
    rare = found
    if len(common):
        rare = found[common[np.minimum(np.searchsorted(common, found), len(common) - 1)] != found]
    for k in (own, own + 1):
        differ, spare, parts = classes.parts(k)
        if not differ:
            continue
        first, part = _part_hashes(rare, parts, k * int(_CLASS), out)
        if parts - len(first) > spare:
            tag = k * int(_CLASS) + int(_WHOLE)
            first, part = _part_hashes(found, parts, tag, out)
            if parts - len(first) > spare:
                gaps = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
                out.append(mix(gaps * _PART + np.uint64((tag + int(_EMPTY)) % 2**64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _part_hashes(grams: np.ndarray, parts: int, tag: int, out: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adds a hash of each part that isn't empty; gives the first place of each, and the part of all n-grams."""
    part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(grams) else np.zeros(0, np.int64)
    if len(first):
        out.append(mix(np.add.reduceat(mix(grams ^ _SALT), first) + part[first] * _PART + np.uint64(tag % 2**64)))
    return first, part


def document_sets(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set): the set as its hash."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = [], []
            for found in sets_of(batch.column(1), size):
                n.append(len(found))
                ids.append(set_id(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "n_shingles", "set"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(trimmed(measure), f"doc_id {kind}, n_shingles long, `set` long")


def common_grams(docs: DataFrame, size: int, text: str, rows: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that most sets hold, sorted, and how many do: at most ``rows``, each in ``least`` sets or more.

    Of every million n-grams a task hands on those that recur, so that counts are a little low.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for found in sets_of(batch.column(0), size):
                own = set_id(found)
                if own is not None and own not in seen:
                    seen.add(own)
                    sets.append(found)
                    held += len(found)
                if held > 1 << 20:
                    yield counted(sets)
                    sets, held = [], 0
        if sets:
            yield counted(sets)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        grams, times = np.unique(np.concatenate(sets), return_counts=True)
        often = times > 2
        return pa.record_batch({"gram": pa.array(grams[often].view(np.int64)), "n": pa.array(times[often])})

    counts = docs.select(text).mapInArrow(trimmed(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= least), "gram-counts")
    kept = counts.where(F.col("n") >= least_count(counts, rows)).toPandas()
    grams = kept["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], kept["n"].to_numpy(np.int64)[order]


def _firsts(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, smallest owner of each, pairs of that owner and each other one)."""
    order = np.lexsort((owner, value))
    value, owner = value[order], owner[order]
    begins = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
    first = owner[begins]
    pairs = np.stack([np.repeat(first, np.diff(np.append(np.flatnonzero(begins), len(value)))), owner])
    return value[begins], first, _distinct_pairs(pairs[:, pairs[0] != pairs[1]])


def _distinct_pairs(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    return pairs[:, np.concatenate(([True], (pairs[:, 1:] != pairs[:, :-1]).any(0)))] if pairs.shape[1] else pairs


def _groups(frame: DataFrame, bytes_: float | None, size: int) -> int:
    """How many groups of ``size`` bytes there are, and no fewer than shuffle partitions."""
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((bytes_ or 0) // size) + 1)


def short_name(name: str) -> Column:
    """The first bits of a set's hash."""
    return F.shiftrightunsigned(name, 64 - BITS)


def candidate_edges(docs: DataFrame, sets: DataFrame, size: int, percent: int, text: str, grams: np.ndarray) -> DataFrame:
    """(src, dst) between the short names of sets of which some part agrees: each with the smallest that has the part. Sets of one short name are told by a loop. ``grams``: the common ones."""
    # A set sends at most a hash a part, or an n-gram, of two classes, twice where its parts run empty.
    n = F.col("n_shingles")
    sent = sets.agg(F.sum(2.0 * BITS / 8 * 4 * F.least(n, n * (3 * (100 - percent)) / percent + 4))).first()[0]
    buckets = _groups(docs, sent, GROUP_BYTES)
    common = docs.sparkSession.sparkContext.broadcast(grams)
    cut = np.uint64(max(0, (2**64 // buckets).bit_length() - BITS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = SizeClasses(percent), set()
        hashes, owners, held = [], [], 0
        for batch in batches:
            for found in sets_of(batch.column(0), size):
                own = set_id(found)
                if own is None or own in seen:
                    continue
                seen.add(own)
                got = signatures(found, classes, common.value)
                hashes.append(got)
                owners.append(np.full(len(got), own % 2**64 >> 64 - BITS, np.int64))
                held += len(got)
                if held > 1 << 20:
                    yield packed(hashes, owners)
                    hashes, owners, held = [], [], 0
        if held:
            yield packed(hashes, owners)

    def packed(hashes: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        """A row a bucket: hashes that fall there with their first owners, and pairs of owners, which may go to any bucket."""
        value, first, pairs = _firsts(np.concatenate(hashes), np.concatenate(owners))
        cells = _dealt((value % np.uint64(buckets)).astype(np.int32), (value // np.uint64(buckets) >> cut).astype(np.int64), first)
        edges = _dealt((pairs[1] % buckets).astype(np.int32), *pairs)
        keys = sorted(cells.keys() | edges.keys())
        return pa.record_batch({"bucket": pa.array(keys, pa.int32()), "cells": pa.array([cells.get(k, b"") for k in keys], pa.binary()), "edges": pa.array([edges.get(k, b"") for k in keys], pa.binary())})

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        value, owner = _undealt(rows["cells"])
        _, _, pairs = _firsts(value, owner)
        pairs = _distinct_pairs(np.concatenate([pairs, np.stack(_undealt(rows["edges"]))], axis=1))
        if len(value) > LARGE:
            trim()
        return pd.DataFrame({"src": pairs[0], "dst": pairs[1]})

    sent_rows = docs.select(text).mapInArrow(trimmed(send), "bucket int, cells binary, edges binary").repartition(buckets, "bucket")
    met = sent_rows.groupBy("bucket").applyInPandas(meet, "src long, dst long")
    name = short_name("set")
    return met.unionByName(sets.groupBy(name.alias("src")).agg(F.count("*").alias("n")).where("n > 1").select("src", F.col("src").alias("dst")))


def _dealt(bucket: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[int, bytes]:
    """Two columns of numbers below 2**BITS by bucket, the left ones rising: byte by byte the steps of the left values, then the right values."""
    order = np.argsort(bucket, kind="stable")
    left, right, bucket = left[order], right[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    planes = lambda values: values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T.tobytes()
    return {int(bucket[a]): planes(np.diff(left[a:b], prepend=0)) + planes(right[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def _undealt(cells: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sides = []
    for cell in cells:
        planes = np.frombuffer(cell, np.uint8).reshape(2, BITS // 8, -1)
        side = np.zeros((2, planes.shape[2], 8), np.uint8)
        side[:, :, : BITS // 8] = planes.transpose(0, 2, 1)
        side = side.view("<i8")[:, :, 0]
        sides.append(np.stack([np.cumsum(side[0]), side[1]]))
    whole = np.concatenate(sides, axis=1)
    return whole[0], whole[1]


def _filter_bits(nodes: DataFrame) -> bytes:
    """A bit for each hash of ``node``, FILTER_BITS in all."""
    width = 1 << 16

    def pack(bits: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(width, np.uint8)
        flags[bits["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [int(bits["part"].iloc[0])], "bits": [np.packbits(flags).tobytes()]})

    place = F.pmod("node", F.lit(FILTER_BITS))
    parts = nodes.select((place / width).cast("int").alias("part"), (place % width).cast("int").alias("bit")).distinct()
    out = bytearray(FILTER_BITS // 8)
    for row in parts.groupBy("part").applyInPandas(pack, "part int, bits binary").collect():
        out[row["part"] * width // 8 : (row["part"] + 1) * width // 8] = row["bits"]
    return bytes(out)


def sets_in(docs: DataFrame, nodes: DataFrame, size: int, text: str, part: Callable[[np.ndarray], np.ndarray] = lambda found: found) -> DataFrame:
    """(node, grams): the n-grams of the sets in ``nodes``, or that ``part`` of them, and of a few others that the filter lets through."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(nodes))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = np.frombuffer(bits.value, np.uint8), set()
        for batch in batches:
            ids, grams, held = [], [], 0
            for found in sets_of(batch.column(0), size):
                own = set_id(found)
                if own is None or own in seen:
                    continue
                place = own % FILTER_BITS
                if flags[place >> 3] >> (7 - (place & 7)) & 1:
                    seen.add(own)
                    ids.append(own)
                    grams.append(part(found).tobytes())
                    held += len(grams[-1])
                if held > 1 << 24:
                    yield pa.record_batch({"node": pa.array(ids, pa.int64()), "grams": pa.array(grams, pa.binary())})
                    ids, grams, held = [], [], 0
            yield pa.record_batch({"node": pa.array(ids, pa.int64()), "grams": pa.array(grams, pa.binary())})

    return docs.select(text).mapInArrow(trimmed(pick), "node long, grams binary")


def prefix(found: np.ndarray, percent: int, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Of a sorted set the rarest n-grams, so many that two sets that link have one of them in common."""
    own = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        own = np.where(common[at] == found, times[at], 0)
    return found[np.argsort(own, kind="stable")[: len(found) - -(-percent * len(found) // 100) + 1]]


def _sized(near: DataFrame, by: list[str], block: int) -> DataFrame:
    """``by``, in how many blocks the sets of (node, cluster, n) go, and their bytes."""
    size = 8 * F.sum("n")
    return near.groupBy(*by).agg(F.ceil(F.greatest(F.count("*") / block, size / BLOCK_BYTES)).cast("int").alias("blocks"), size.alias("bytes"))


def refined(docs: DataFrame, near: DataFrame, size: int, percent: int, text: str, block: int, common: np.ndarray, times: np.ndarray) -> DataFrame:
    """(node, cluster, n), the clusters of more than a block cut into those whose sets share n-grams of their prefixes; sets that are left alone go."""
    large = _sized(near, ["cluster"], block).where("blocks > 1").select("cluster")
    sets = stored(near.join(large, "cluster"), "large-clusters")
    if sets.isEmpty():
        return near
    told = docs.sparkSession.sparkContext.broadcast((common, times))
    grams = sets_in(docs, sets, size, text, lambda found: prefix(found, percent, *told.value)).join(sets.select("node", "cluster"), "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A set with the n-grams of its prefix, which stand for themselves inside their cluster."""
        for batch in batches:
            for rows in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                n = pc.binary_length(rows.column(2)).to_numpy() // 8
                held = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint64)
                node, cluster = (np.repeat(rows.column(k).to_numpy(), n) for k in (0, 1))
                yield pa.record_batch({"src": pa.array(node), "dst": pa.array(mix(held ^ mix(cluster.view(np.uint64))).view(np.int64))})

    met = connected_components(grams.select("node", "cluster", "grams").mapInArrow(trimmed(link), "src long, dst long"))
    cut = sets.join(met, "node").select("node", F.xxhash64("cluster", "component").alias("cluster"), "n")
    cut = cut.join(cut.groupBy("cluster").agg(F.count("*").alias("sets")).where("sets > 1"), "cluster", "left_semi")
    return stored(near.join(large, "cluster", "left_anti").select("node", "cluster", "n").unionByName(cut.select("node", "cluster", "n")), "near-clusters")


def link_product(rows: list[np.ndarray], percent: int, split: int | None = None) -> np.ndarray:
    """Which of the rows link, from their overlap counts: all with all, or those before ``split`` with the rest."""
    a, b = (slice(None), slice(None)) if split is None else (slice(0, split), slice(split, None))
    sizes = np.array([len(r) for r in rows])
    total = sizes[a][:, None] + sizes[b][None, :]
    need = needed(total, percent)
    alive = need <= np.minimum(sizes[a][:, None], sizes[b][None, :])
    counts = np.zeros(total.shape, np.float32)
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    rank = np.cumsum(times > 1) - 1
    owner, column = owner[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left = np.bincount(owner, minlength=len(rows))
    # Columns that few rows hold: the sparse product, an entry of one side with those of the other in its column.
    edge = len(rows) if split is None else split
    n_columns = int(column[-1]) + 1 if len(column) else 0
    on_a, on_b = owner < edge, (owner >= edge) if split is not None else np.ones(len(owner), bool)
    in_a, in_b = (np.bincount(column[side], minlength=n_columns) for side in (on_a, on_b))
    sparse = in_a * in_b <= DENSE * total.size
    some = np.flatnonzero(on_a & sparse[column])
    places_b = np.flatnonzero(on_b)
    first_b = np.searchsorted(column[places_b], np.arange(n_columns))
    cost = np.cumsum(in_b[column[some]])
    at = 0
    while at < len(some):
        upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
        part = some[at:upto]
        n = in_b[column[part]]
        before = np.cumsum(n) - n
        others = places_b[np.arange(int(n.sum())) + np.repeat(first_b[column[part]] - before, n)]
        cell = np.repeat(owner[part], n) * total.shape[1] + owner[others] - (0 if split is None else split)
        counts += np.bincount(cell, minlength=total.size).reshape(total.shape)
        at = upto
    left = left - np.bincount(owner[sparse[column]], minlength=len(rows))
    owner, column = owner[~sparse[column]], column[~sparse[column]]
    column = (np.cumsum(~sparse) - 1)[column]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        alive &= counts + np.minimum(left[a][:, None], left[b][None, :]) >= need
        if not alive.any():
            break
        x, y = np.searchsorted(column, [low, low + SLAB])
        slab = np.zeros((len(rows), SLAB), np.float32)
        slab[owner[x:y], column[x:y] - low] = 1
        counts += slab[a] @ slab[b].T
        left = left - np.bincount(owner[x:y], minlength=len(rows))
    return alive & (counts >= need)


def forest(links: np.ndarray, ids: np.ndarray, split: int | None = None) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, one for each row but the first of a tree."""
    n = len(ids)
    near = np.eye(n, dtype=bool)
    if split is None:
        near |= links | links.T
    else:
        near[:split, split:] = links
        near[split:, :split] = links.T
    label = np.arange(n)
    while True:
        lower = np.where(near, label[None, :], n).min(1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return [(int(ids[k]), int(ids[i])) for i, k in enumerate(label) if i != k]
        label = lower


def linked_sets(grams: DataFrame, near: DataFrame, percent: int, block: int) -> DataFrame:
    """(src, dst) that connect linked sets; ``grams``: (node, grams), ``near``: (node, cluster, n), n the size of the set."""
    classes, most = SizeClasses(percent), near.agg(F.max("n")).first()[0] or 1
    classes.of(most)
    kind = F.size(F.filter(F.array(*[F.lit(s) for s in classes.starts]), lambda s: s <= F.col("n")))
    sized = near.withColumn("k", kind)
    large = _sized(sized, ["cluster"], block).where("blocks > 1").select("cluster")
    parts = _sized(sized.join(large, "cluster"), ["cluster", "k"], block)
    beside = [parts.select("cluster", (F.col("k") - step).alias("k"), F.col("blocks").alias(name)) for step, name in ((-1, "below"), (1, "above"))]
    parts = stored(parts.join(beside[0], ["cluster", "k"], "left").join(beside[1], ["cluster", "k"], "left").fillna(0, ["below", "above"]), "cluster-parts")
    small = sized.join(large, "cluster", "left_anti").agg(F.sum(8 * F.col("n"))).first()[0] or 0
    sent = parts.agg(F.sum(F.col("bytes") * (F.col("blocks") + F.col("below") + F.col("above")))).first()[0] or 0
    packs = _groups(near, small, GROUP_BYTES)

    # Small clusters share a task; of a large one a task has two blocks, of one size class or of neighbours.
    key = lambda k, b: k.cast("long") * (1 << 32) + b
    block_of = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = sized.join(parts.drop("bytes"), ["cluster", "k"], "left").withColumn("own", F.coalesce(key(F.col("k"), block_of), F.lit(-1)))
    to = lambda step, n: F.transform(F.filter(F.sequence(F.lit(0), F.col(n)), lambda b: b < F.col(n)), lambda b: key(F.col("k") + step, b))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.concat(to(-1, "below"), to(0, "blocks"), to(1, "above")))
    dealt = dealt.withColumn("other", F.explode(others)).select(
        F.when(F.col("own") < 0, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(F.col("cluster")).alias("pack"),
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "cluster", "own", "node",
    )

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        for _, cluster in rows.sort_values(["cluster", "own"], kind="stable").groupby("cluster", sort=False):
            ids = cluster["node"].to_numpy(np.int64)
            sets = [np.frombuffer(g, np.uint64) for g in cluster["grams"]]
            split = None if low == high else int((cluster["own"] == low).sum())
            if len(ids) < 2 or split in (0, len(ids)):
                continue
            found += forest(link_product(sets, percent, split), ids, split)
        if sum(map(len, rows["grams"])) > 8 * LARGE:
            trim()
        return pd.DataFrame(found, columns=["src", "dst"]).astype("int64")

    tasks = _groups(near, small + sent, GROUP_BYTES)
    dealt = grams.join(dealt, "node").repartition(tasks, "pack", "low", "high")
    return dealt.groupBy("pack", "low", "high").applyInPandas(multiply, "src long, dst long")


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", block: int = 512, common_rows: int = 1 << 17) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links need 100 * overlap >= percent * union.

    component_id is the smallest doc_id that links reach; of an empty set it is its own.
    """
    sets = stored(document_sets(docs, size, doc_id, text), "document-sets")
    # From here on a set goes by its hash, and in the end by the smallest doc_id that has it.
    named = stored(sets.where("`set` IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("name"), F.min("n_shingles").alias("n_shingles")), "set-names")
    common, times = common_grams(docs, size, text, common_rows)
    near = connected_components(candidate_edges(docs, named, size, percent, text, common))
    near = near.select(F.col("node").alias("short"), F.col("component").alias("cluster")).join(named.select(F.col("set").alias("node"), F.col("n_shingles").alias("n"), short_name("set").alias("short")), "short").drop("short")
    near = refined(docs, stored(near, "near-clusters"), size, percent, text, block, common, times)
    grams = sets_in(docs, near, size, text).groupBy("node").agg(F.first("grams").alias("grams"))
    linked = stored(linked_sets(grams, near, percent, block), "linked-sets")
    ends = linked.join(named.select(F.col("set").alias("src"), F.col("name").alias("u")), "src").join(named.select(F.col("set").alias("dst"), F.col("name").alias("v")), "dst")
    components = connected_components(ends, "u", "v").select(F.col("node").alias("name"), F.col("component").alias("component_id"))
    of_set = named.join(components, "name", "left").select("set", F.coalesce("component_id", "name").alias("component_id"))
    full = sets.where("`set` IS NOT NULL").join(of_set, "set").select("doc_id", "n_shingles", "component_id")
    empty = sets.where("`set` IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)
