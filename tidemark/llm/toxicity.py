"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting reads labelled rows only outside the held-out fifth, at most ``max_examples`` a class (the
lowest key hashes), plus twice as many for calibration.  Terms are the lower-case words of the
examples and the words' first four bytes, all of them.  A term weighs (1 + ln times) * idf * (FLOOR +
chi-square), with the inverse document frequency over all documents and the chi-square of the
term's presence with the label over the examples: all terms count, those that go with the label most.

The index has postings (example, weight) of each term, cut into blocks of ``BLOCK`` examples, and the largest
weight of each block.  Terms that at least one in ``DENSE`` examples hold are columns of a matrix instead, whose
product with some texts gives a known part of all their cosines at once.  A text's blocks are visited by falling
bound (the largest known part in it, and the sum of the other term weights times the block maxima) until no block
can reach the k-th cosine any more; within a block all cosines are exact.  Votes of the ``k`` nearest are weighted by the square of
1 - distance^2 / 2 (the cosine), and the share of label 1 is calibrated by isotonic regression on labelled rows that are not examples.  A text
that shares no term with any example has no neighbours, and gets the rate of such rows.

Scores use the text only.  Without any labelled rows all scores are 0.  Null text is empty;
whole texts are read; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.samples import sample_ids, with_texts
from tidemark.llm.wordhash import PUNCTUATION, hash_texts

BLOCK, DENSE = 256, 8
#: Texts whose known parts are found at once.
TEXTS = 256
#: Weight of a vote for label 0 that every text starts with: far neighbours alone don't decide.
DOUBT = 0.5
#: What a term weighs that goes with neither label, in units of chi-square.
FLOOR = 0.05
_PREFIX = np.uint64(0x5851F42D4C957F2D)


def term_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each piece of texts: index of the first, text of each term, term; words and word beginnings alike."""
    pieces = zip(hash_texts(texts, PUNCTUATION), hash_texts(texts, PUNCTUATION, prefix=4), strict=True)
    for (at, before, words), (_, _, starts) in pieces:
        owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
        yield at, np.concatenate([owner, owner]), np.concatenate([words, starts ^ _PREFIX])


def held_out(key: str, folds: int = 5):
    return F.crc32(F.col(key).cast("string")) % folds == 0


def example_terms(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of all terms of (label, text), their chi-square with the label); bounded by the examples' texts."""

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for at, owner, term in term_hashes(batch.column(1)):
                once = np.unique(np.stack([term, owner.astype(np.uint64)]), axis=1)
                y = labels[at + once[1].astype(np.int64)]
                yield pa.record_batch({"term": pa.array(once[0].view(np.int64)), "toxic": pa.array(y.astype(np.int64))})

    seen = examples.select("label", "text").mapInArrow(presence, "term long, toxic long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).toPandas()
    counts = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n1, n0 = float(counts.get(1, 0)), float(counts.get(0, 0))
    terms, a, b = (seen[c].to_numpy() for c in ("term", "a", "b"))
    order = np.argsort(terms.astype(np.int64).view(np.uint64))
    terms, a, b = terms.astype(np.int64).view(np.uint64)[order], a[order].astype(float), b[order].astype(float)
    odds = a * (n0 - b) - b * (n1 - a)
    chi2 = (n1 + n0) * odds * odds / np.maximum((a + b) * (n1 + n0 - a - b) * n1 * n0, 1.0)
    return terms, chi2


def vectors(texts: pa.Array, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, terms present, times) for texts that hold any of ``terms``."""
    if not len(terms):
        return
    for at, owner, term in term_hashes(texts):
        place = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
        known = terms[place] == term
        cell, times = np.unique(owner[known] * len(terms) + place[known], return_counts=True)
        text, place = cell // len(terms), cell % len(terms)
        cuts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1], [True]))) if len(text) else [0]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield at + int(text[x]), place[x:y], times[x:y]


def document_frequencies(docs: DataFrame, text: str, terms: np.ndarray) -> np.ndarray:
    """Texts of the whole table that hold each term; tasks hand on one count a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, place, _ in vectors(batch.column(0), shared.value):
                n[place] += 1
        at = np.flatnonzero(n)
        yield pa.record_batch({"term": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    out = np.zeros(len(terms))
    counts = docs.select(text).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[counts["term"].to_numpy(np.int64)] = counts["n"].to_numpy()
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all ranges, one range after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class BlockMaxIndex:
    """Postings of the unit vectors of labelled examples by term and block, with the largest weight of each such list.

    ``scale`` is what a term weighs, its idf times its association with the label.
    """

    def __init__(self, scale: np.ndarray, examples: list[tuple[int, str, np.ndarray, np.ndarray]]):
        self.scale = scale
        weighted = [(y, doc, place, self.weights(place, times)) for y, doc, place, times in examples]
        # Examples with the same label and strongest term stand together, which keeps the maxima tight.
        weighted.sort(key=lambda e: (e[0], int(e[2][np.argmax(e[3])]), e[1]))
        self.labels = np.array([e[0] for e in weighted], np.int64)
        self.ids = [e[1] for e in weighted]
        self.blocks = -(-len(weighted) // BLOCK)
        term = np.concatenate([e[2] for e in weighted]) if weighted else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(weighted)), [len(e[2]) for e in weighted])
        weight = np.concatenate([e[3] for e in weighted]) if weighted else np.zeros(0)
        often = np.bincount(term, minlength=len(scale)) * DENSE >= max(1, len(weighted))
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.blocks * BLOCK))
        known = often[term]
        self.dense[self.column[term[known]], owner[known]] = weight[known]
        term, owner, weight = term[~known], owner[~known], weight[~known]
        order = np.lexsort((owner, term))
        term, self.owner, self.weight = term[order], owner[order].astype(np.int32), weight[order]
        # A list is a term's postings in a block; lists of a term lie together.
        block = self.owner // BLOCK
        begins = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.begin, self.size = begins, np.diff(np.append(begins, len(term)))
        self.block = block[begins]
        self.most = np.maximum.reduceat(self.weight, begins) if len(begins) else np.zeros(0)
        self.lists = np.searchsorted(term[begins], np.arange(len(scale) + 1))

    def weights(self, place: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.scale[place]
        return w / np.sqrt((w * w).sum())

    def known(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The part of the cosines of texts (terms, weights) with all examples that comes from the matrix."""
        columns = np.zeros((len(rows), len(self.dense)))
        for i, (place, w) in enumerate(rows):
            at = self.column[place]
            columns[i, at[at >= 0]] = w[at >= 0]
        return columns @ self.dense

    def nearest(self, place: np.ndarray, w: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0; ``part`` is what ``known`` gives of the text."""
        n_lists = self.lists[place + 1] - self.lists[place]
        lists, own = _ranges(self.lists[place], n_lists), np.repeat(w, n_lists)
        block = self.block[lists]
        bound = np.bincount(block, own * self.most[lists], self.blocks) + part.reshape(self.blocks, BLOCK).max(1)
        by_block = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[by_block], np.arange(self.blocks + 1))
        at, cosines = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(at) == k and bound[b] < cosines[-1] - 1e-9:
                break
            some = by_block[cuts[b] : cuts[b + 1]]
            size = self.size[lists[some]]
            found = _ranges(self.begin[lists[some]], size)
            got = np.bincount(self.owner[found] - b * BLOCK, self.weight[found] * np.repeat(own[some], size), BLOCK) + part[b * BLOCK : (b + 1) * BLOCK]
            alive = np.flatnonzero(got > 0 if len(at) < k else got >= cosines[-1])
            at, cosines = np.concatenate([at, b * BLOCK + alive]), np.concatenate([cosines, got[alive]])
            best = np.lexsort((at, -cosines))[:k]
            at, cosines = at[best], cosines[best]
        return at, cosines

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        weight = cosines.astype(float) ** 2
        return float((weight * self.labels[at]).sum() / (weight.sum() + DOUBT))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: rising means of y by x, as corners of a step function; equal x are one point, whatever their order."""
    points, place, times = np.unique(x, return_inverse=True, return_counts=True)
    sums = np.bincount(place, y, len(points))
    pools: list[list[float]] = []
    for a, b, n in zip(points, sums, times, strict=True):
        pools.append([b, n, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, n_last, end = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n_last, end]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


class ToxicityModel:
    """An index, its calibration and the rate of rows without neighbours."""

    def __init__(self, terms: np.ndarray, index: BlockMaxIndex, k: int):
        self.terms, self.index, self.k = terms, index, k
        self.ends, self.rates, self.rest = np.array([1.0]), np.array([0.0]), 0.0

    def votes(self, texts: pa.Array) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        rows = vectors(texts, self.terms)
        while some := [(i, place, self.index.weights(place, times)) for i, place, times in islice(rows, TEXTS)]:
            parts = self.index.known([(place, w) for _, place, w in some])
            for (i, place, w), part in zip(some, parts, strict=True):
                at, cosines = self.index.nearest(place, w, part, self.k)
                if len(at):
                    yield i, self.index.vote(at, cosines), at, cosines

    def calibrated(self, vote: float) -> float:
        return float(self.rates[min(np.searchsorted(self.ends, vote), len(self.rates) - 1)])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", k: int = 15, max_examples: int = 1024) -> ToxicityModel:
    spark = docs.sparkSession
    usable = labels.select(key, F.col(label).alias("label")).where(F.col("label").isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max("label").alias("label"))
    chosen = sample_ids(usable.where("label = 1"), key, max_examples).unionByName(sample_ids(usable.where("label = 0"), key, max_examples))
    texts = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    examples = with_texts(texts, chosen, key)
    terms, chi2 = example_terms(examples)
    n_docs = docs.count()
    scale = (np.log((1 + n_docs) / (1 + document_frequencies(docs, text, terms))) + 1) * (FLOOR + chi2)
    shared = spark.sparkContext.broadcast(terms)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(vectors(batch.column(1), shared.value))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch({"id": batch.column(0).take(at).cast(pa.string()), "label": batch.column(2).take(at).cast(pa.int64()), "place": pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary()), "times": pa.array([r[2].astype(np.int32).tobytes() for r in rows], pa.binary())})

    rows = examples.select(key, "text", "label").mapInArrow(embed, "id string, label long, place binary, times binary").collect()
    distinct = sorted({(r["id"], r["label"], bytes(r["place"]), bytes(r["times"])) for r in rows})
    index = BlockMaxIndex(scale, [(y, doc, np.frombuffer(p, np.int32).astype(np.int64), np.frombuffer(t, np.int32)) for doc, y, p, t in distinct])
    model = ToxicityModel(terms, index, k)
    sample = sample_ids(usable.join(chosen.select(key), key, "left_anti"), key, 2 * max_examples, salt=1)
    ready = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.full(batch.num_rows, -1.0)
            for i, vote, _, _ in ready.value.votes(batch.column(0)):
                raw[i] = vote
            yield pa.record_batch({"vote": pa.array(raw), "label": batch.column(1).cast(pa.int64())})

    got = with_texts(texts, sample, key).select("text", "label").mapInArrow(rate, "vote double, label long").collect()
    x, y = np.array([r["vote"] for r in got]), np.array([r["label"] for r in got], float)
    if not len(y):  # every labelled row is an example
        model.ends, model.rates, model.rest = np.array([0.5, 1.0]), np.array([0.0, 1.0]), 0.0
        return model
    if (x >= 0).any():
        model.ends, model.rates = isotonic(x[x >= 0], y[x >= 0])
    model.rest = float(y[x < 0].mean()) if (x < 0).any() else float(y.mean())
    return model


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", evidence: int = 3) -> DataFrame:
    """(key, held_out, score, predicted, neighbours, evidence): evidence names the nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            scores, n = np.full(batch.num_rows, model.rest), np.zeros(batch.num_rows, np.int64)
            proof: list[str] = [""] * batch.num_rows
            for i, vote, at, cosines in model.votes(batch.column(2)):
                scores[i], n[i] = model.calibrated(vote), len(at)
                proof[i] = ",".join(f"{model.index.ids[j]}:{c:.3f}" for j, c in zip(at[:evidence], cosines[:evidence], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(n), pa.array(proof, pa.string())], names=["key", "held_out", "score", "predicted", "neighbours", "evidence"])

    kind = docs.schema[key].dataType.simpleString()
    rated = docs.select(F.col(key).alias("key"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), text).mapInArrow(rate, f"key {kind}, held_out boolean, score double, predicted int, neighbours long, evidence string")
    return rated.withColumnRenamed("key", key)
