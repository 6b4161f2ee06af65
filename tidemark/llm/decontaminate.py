"""Benchmark decontamination by greedy string tiling.

Token runs that a document shares with a benchmark item are seeds: the hash of every run of
``least`` tokens is looked up among those of all items.  For each (document, item) pair with
enough seeds, greedy string tiling marks the longest common runs that don't overlap with marked
ones, again and again, down to ``least`` tokens; runs are found by running Karp-Rabin over
unmarked tokens (prefix sums give the hash of every run at any width in one pass), with a search length that starts long and halves.  Tiles may stand in any
order, so that a reordered passage is caught.  A pair counts from a ``coverage`` of the item's
tokens on.

Tokens: runs of ASCII letters and digits and other characters beyond ASCII; A-Z count as a-z.
Items of fewer than ``least`` tokens are matched as one run; items without tokens never match.

Only benchmark seeds are broadcast, in blocks of at most ``block_bytes`` of item text; a larger
benchmark takes a pass over the documents for each block.  Whole documents are read, each in its
own task.  Null text is empty.  Repeated rows are reported each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.wordhash import PUNCTUATION, hash_texts, shingles


class Item:
    """Tokens of a benchmark item and the length that its tiles have at least."""

    def __init__(self, item_id: object, tokens: np.ndarray, least: int):
        self.item_id, self.tokens, self.least = item_id, tokens, min(least, len(tokens))
        self.seeds = shingles(tokens, self.least)


def _runs(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` unmarked tokens."""
    sums = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(sums[size:] == sums[:-size]) if len(marked) >= size else np.zeros(0, np.int64)


def tiles(document: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in document, start in item, length) of the marked runs, the longest first.

    Of equal lengths the first in the document goes first, then the first in the item.  Runs of
    one length are marked in one go; where they cut into others, what is left is searched again.
    """
    marked = [np.zeros(len(document), bool), np.zeros(len(item), bool)]
    found: list[tuple[int, int, int]] = []
    size = max(least, min(len(document), len(item)))
    while True:
        i, j, length = _matches(document, item, marked, size)
        cut = False
        while len(i) and not cut:
            n = int(length[0])
            top = int(np.searchsorted(-length, -n, "right"))
            at_i, at_j = i[:top], j[:top]
            while len(at_i):
                x, y = int(at_i[0]), int(at_j[0])
                marked[0][x : x + n] = marked[1][y : y + n] = True
                found.append((x, y, n))
                rest = (np.abs(at_i - x) >= n) & (np.abs(at_j - y) >= n)
                cut |= len(at_i) - int(rest.sum()) > 1
                at_i, at_j = at_i[rest], at_j[rest]
            i, j, length = i[top:], j[top:], length[top:]
            whole = _free(marked[0], i, length) & _free(marked[1], j, length)
            cut |= not whole.all()
        if cut:
            continue
        if size == least:
            return found
        size = max(least, size // 2)


def _free(marked: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether no token of a run is marked."""
    sums = np.concatenate(([0], np.cumsum(marked)))
    return sums[at + length] == sums[at]


def _matches(document: np.ndarray, item: np.ndarray, marked: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in document, start in item, length) of maximal common runs of at least ``size`` unmarked tokens: longest first, then by place."""
    at_item, at_document = _runs(marked[1], size), _runs(marked[0], size)
    none = np.zeros(0, np.int64)
    if not len(at_item) or not len(at_document):
        return none, none, none
    wanted, hashes = shingles(item, size)[at_item], shingles(document, size)[at_document]
    hits = np.isin(hashes, wanted)
    at_document, hashes = at_document[hits], hashes[hits]
    order = np.argsort(hashes, kind="stable")
    at_document, hashes = at_document[order], hashes[order]
    low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for j, x, y in zip(at_item.tolist(), low.tolist(), high.tolist(), strict=True):
        i = at_document[x:y]
        if len(i) and j and not marked[1][j - 1]:
            # Others are parts of runs that began a token before.
            before = np.maximum(i - 1, 0)
            i = i[(i == 0) | (document[before] != item[j - 1]) | marked[0][before]]
        pairs.append((i, np.full(len(i), j)))
    i, j = (np.concatenate(side) for side in zip(*pairs, strict=True))
    length = np.full(len(i), size)
    growing = np.arange(len(i))
    while len(growing):
        x, y = i[growing] + length[growing], j[growing] + length[growing]
        growing, x, y = (v[(x < len(document)) & (y < len(item))] for v in (growing, x, y))
        growing = growing[(document[x] == item[y]) & ~marked[0][x] & ~marked[1][y]]
        length[growing] += 1
    order = np.lexsort((j, i, -length))
    return i[order], j[order], length[order]


def compare(tokens: np.ndarray, hits: np.ndarray, item: Item, coverage: float) -> tuple[int, int] | None:
    """(tokens covered, tiles) of an item in a document, if enough; ``hits``: where its seeds stand there."""
    found = np.isin(item.seeds, shingles(tokens, item.least)[hits])
    reach = np.zeros(len(item.tokens) + 1, np.int64)
    np.add.at(reach, np.flatnonzero(found), 1)
    np.add.at(reach, np.flatnonzero(found) + item.least, -1)
    if (np.cumsum(reach)[:-1] > 0).sum() < coverage * len(item.tokens):
        return None  # tiles are made of seeds
    # Tokens outside seeds can't be in a tile; a token that no item has stands for each gap.
    inside = np.zeros(len(tokens), bool)
    for k in range(item.least):
        inside[hits + k] = True
    kept = np.where(inside, tokens, np.uint64(0))
    kept = kept[np.flatnonzero(inside | np.concatenate(([False], inside[:-1])))]
    got = tiles(kept, item.tokens, item.least)
    covered = sum(t[2] for t in got)
    return (covered, len(got)) if covered >= coverage * len(item.tokens) else None


class Seeds:
    """Seeds of all items of a block by length, for lookup by position."""

    def __init__(self, items: list[Item]):
        self.items = [i for i in items if len(i.tokens)]
        by_length: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, item in enumerate(self.items):
            for h in set(item.seeds.tolist()):
                by_length[item.least][h].append(k)
        self.by_length = {n: (np.sort(np.fromiter(at, np.uint64, len(at))), dict(at)) for n, at in by_length.items()}

    def pairs(self, tokens: np.ndarray, before: np.ndarray, coverage: float) -> Iterator[tuple[int, Item, int, int]]:
        """(text, item, covered, tiles) for the texts of a piece."""
        for least, (hashes, owners) in self.by_length.items():
            if len(tokens) < least:
                continue
            runs = shingles(tokens, least)
            at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, runs), len(hashes) - 1)] == runs)
            text = np.searchsorted(before, at, "right") - 1
            whole = at + least <= before[text + 1]
            at, text = at[whole], text[whole]
            for one in np.unique(text):
                places = defaultdict(list)
                for p in at[text == one].tolist():
                    for k in owners[int(runs[p])]:
                        places[k].append(p - before[one])
                own = tokens[before[one] : before[one + 1]]
                for k, hits in places.items():
                    got = compare(own, np.array(hits), self.items[k], coverage)
                    if got:
                        yield int(one), self.items[k], *got


def _blocks(benchmark: DataFrame, item_id: str, text: str, least: int, block_bytes: int) -> Iterator[Seeds]:
    """Seeds of the items, block by block; a block's text is bounded but for a single larger item."""
    sized = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        rows = sized.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        items = []
        for at, before, hashes in hash_texts(pa.array([r["text"] for r in rows], pa.string()), PUNCTUATION):
            items += [Item(rows[at + i]["id"], hashes[before[i] : before[i + 1]], least) for i in range(len(before) - 1)]
        yield Seeds(items)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, least: int = 5, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, tiles, coverage) of every pair from ``coverage`` on."""
    spark, out = docs.sparkSession, None
    kinds = (docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString())
    for seeds in _blocks(benchmark, item_id, text, least, block_bytes):
        shared = spark.sparkContext.broadcast(seeds)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for at, before, hashes in hash_texts(batch.column(1), PUNCTUATION):
                    rows += [(at + i, item, covered, n) for i, item, covered, n in shared.value.pairs(hashes, before, coverage)]
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": batch.column(0)[i].as_py(), "item_id": item.item_id, "item_tokens": len(item.tokens), "covered": covered, "tiles": n, "coverage": covered / len(item.tokens)} for i, item, covered, n in rows],
                    pa.schema([("doc_id", batch.column(0).type), ("item_id", pa.string()), ("item_tokens", pa.int64()), ("covered", pa.int64()), ("tiles", pa.int64()), ("coverage", pa.float64())]),
                )

        found = docs.select(doc_id, text).mapInArrow(search, f"doc_id {kinds[0]}, item_id string, item_tokens long, covered long, tiles long, coverage double")
        found = found.withColumn("item_id", F.col("item_id").cast(kinds[1]))
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, least: int = 5, item_id: str = "item_id", text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that cover no item; rows stay where they are."""
    out = docs
    for seeds in _blocks(benchmark, item_id, text, least, block_bytes):
        shared, column = docs.sparkSession.sparkContext.broadcast(seeds), docs.columns.index(text)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, column=column) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for at, before, hashes in hash_texts(batch.column(column), PUNCTUATION):
                    for i, *_ in shared.value.pairs(hashes, before, coverage):
                        clean[at + i] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out
