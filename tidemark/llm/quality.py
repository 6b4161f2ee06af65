"""Quality classifier by co-training of two views.

The content view sees the text: shares of kinds of characters, repetition, and hashed words and word pairs.
The metadata view sees source, language and length as recorded; length is in no other view.  Both are
logistic regressions, fitted on labelled rows first.  In each round every document of the table is scored by
both views; where one is sure, its label counts as a training row of the other.  Tasks add these rows up to
the gradient and the bound of the curvature that the other view's next step needs, a step a round, so that the pool is the whole table and
no row of it leaves its task; together the pool weighs as much as the labelled rows at most.  Then both views
are calibrated on labelled rows kept out of training, and a logistic combination of their log odds, fitted on
the same rows, scores all documents.

Fitting reads at most ``max_labelled`` labelled rows (the lowest key hashes); pool and scores cover every
whole text.  Without both classes among the labelled rows all scores are the rate of label 1, or 1
without any.  Null text is empty, null metadata is a value of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.samples import sample_ids, with_texts
from tidemark.llm.wordhash import hash_texts, mix, shingles

#: Sums of tasks are added up in so many groups.
SLOTS = 32

#: Metadata features: log length and its square, hashed source and language.
SOURCES, LANGUAGES = 32, 16
#: Content features: shape of the text, then hashed words and hashed word pairs.
SHAPE, HASHED = 11, 64
#: Widths of the two views.
CONTENT, META = SHAPE + 2 * HASHED, 2 + SOURCES + LANGUAGES
_BUCKET = np.uint64(64 - 6)
HASHED_RIDGE = 30.0
_CLASSES = np.zeros((256, 7), np.int64)
_CLASSES[65:91, 0] = 1
_CLASSES[97:123, 1] = 1
_CLASSES[48:58, 2] = 1
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()], 3] = 1
_CLASSES[[ord(c) for c in "|#$%&*<>{}[]=_~^\\"], 4] = 1
_CLASSES[[9, 10, 11, 12, 13, 32], 5] = 1
_CLASSES[128:, 6] = 1


def content_features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text; whole texts count."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out = np.zeros((n, CONTENT))
    for i in range(n):
        counts = np.bincount(data[bounds[i] : bounds[i + 1]], minlength=256) @ _CLASSES
        size, letters = max(1, bounds[i + 1] - bounds[i]), max(1, counts[0] + counts[1])
        out[i, :6] = counts[0] / letters, counts[2] / size, counts[3] / size, counts[4] / size, counts[5] / size, counts[6] / size
    for at, before, words in hash_texts(texts):
        for i in range(len(before) - 1):
            own = words[before[i] : before[i + 1]]
            if not len(own):
                continue
            _, times = np.unique(own, return_counts=True)
            triples = shingles(own, 3)
            out[at + i, 6:SHAPE] = (
                len(times) / len(own),
                times.max() / len(own),
                (own[1:] == own[:-1]).mean() if len(own) > 1 else 0,
                len(np.unique(triples)) / len(triples),
                (bounds[at + i + 1] - bounds[at + i]) / len(own) / 10,
            )
        n_texts, n_words = len(before) - 1, np.diff(before)
        owner = np.repeat(np.arange(n_texts), n_words)
        pairs = mix(words[:-1] + (words[1:] << np.uint64(1)))[owner[1:] == owner[:-1]]
        sides = ((owner, words), (owner[1:][owner[1:] == owner[:-1]], pairs))
        for k, (text, hashes) in enumerate(sides):
            counts = np.bincount(text * HASHED + (hashes >> _BUCKET).astype(np.int64), minlength=n_texts * HASHED).reshape(n_texts, HASHED)
            first = SHAPE + k * HASHED
            out[at : at + n_texts, first : first + HASHED] = np.sqrt(counts / np.maximum(n_words, 1)[:, None])
    return out


def _hashed(values: list, width: int) -> np.ndarray:
    import zlib

    out = np.zeros((len(values), width))
    out[np.arange(len(values)), [0 if v is None else 1 + zlib.crc32(str(v).encode()) % (width - 1) for v in values]] = 1
    return out


def metadata_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    length = np.log1p(np.array([max(0, x or 0) for x in n_chars], float))
    return np.column_stack([length, length**2 / 10, _hashed(source, SOURCES), _hashed(lang, LANGUAGES)])


class Logistic:
    """Logistic regression with standardised features and a small ridge, by Newton steps.

    The first ``squared`` features count with their squares, too.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, squared: int | None = None):
        self.squared = 0 if squared is None else squared
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self.design(x)
        self.w = np.zeros(z.shape[1])
        # One hashed word tells little by itself.
        self.ridge = np.ones(len(self.w))
        self.ridge[self.squared : x.shape[1]] = 1.0 if squared is None else HASHED_RIDGE
        self.ridge[-1] = 1e-6
        for _ in range(25):
            if self.step(*self.sums(z, y)) < 1e-6:
                break

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        if self.squared:  # one frequent word shouldn't outweigh the shape of a text
            z[:, self.squared :] = np.clip(z[:, self.squared :], -2, 2)
        return np.column_stack([z, z[:, : self.squared] ** 2 / 4, np.ones(len(x))])

    def sums(self, z: np.ndarray, y: np.ndarray, bound: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss of some rows; or, as ``bound``, the most that the curvature can be
        anywhere, with which a step never overshoots."""
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        weight = np.full(len(z), 0.25) if bound else p * (1 - p) + 1e-9
        return z.T @ (p - y), (z * weight[:, None]).T @ z

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> float:
        """A damped Newton step; gives its largest part."""
        step = np.linalg.solve(curvature + np.diag(self.ridge), gradient + self.ridge * self.w)
        most = float(np.abs(step).max())
        self.w = self.w - step * min(1, 5 / (most + 1e-12))
        return most

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.w, -30, 30)


class CoTrained:
    """Two views and the combination of their log odds."""

    def __init__(self, content: Logistic | None, metadata: Logistic | None, both: Logistic | None, rate: float):
        self.content, self.metadata, self.both, self.rate = content, metadata, both, rate

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.both is None or not len(content):
            return np.full(len(content), self.rate)
        odds = np.column_stack([self.content.odds(content), self.metadata.odds(metadata)])
        return 1 / (1 + np.exp(-self.both.odds(odds)))


class View(NamedTuple):
    """A view's model, and how sure its odds are on labelled rows that it wasn't trained on."""

    model: Logistic
    checked: Logistic

    def sure(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.checked.odds(self.model.odds(x)[:, None])))


def pool_sums(views: list[View], sides: tuple[np.ndarray, np.ndarray], sure: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each view, of the rows that the other one is sure of: how many, gradient and curvature."""
    out = []
    for taker in (0, 1):
        p = views[1 - taker].sure(sides[1 - taker])
        rows = (p >= sure) | (p <= 1 - sure)
        model = views[taker].model
        out.append((int(rows.sum()), *model.sums(model.design(sides[taker][rows]), (p[rows] >= 0.5).astype(float), bound=True)))
    return out


def co_train(sides: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Callable[[list[View]], list[tuple[int, np.ndarray, np.ndarray]]], rounds: int) -> CoTrained:
    """Labelled rows come in a random order, and every third is kept for calibration; ``pool`` gives the sums of the whole table for a round's views."""
    rate = float(y.mean()) if len(y) else 1.0
    kept = np.arange(len(y)) % 3 == 2
    if len(y) < 12 or len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        return CoTrained(None, None, None, rate)
    models = [Logistic(x[~kept], y[~kept], squared=(SHAPE, None)[k]) for k, x in enumerate(sides)]
    for _ in range(rounds):
        views = [View(m, Logistic(m.odds(x[kept])[:, None], y[kept])) for m, x in zip(models, sides, strict=True)]
        for model, x, (n, gradient, curvature) in zip(models, sides, pool(views), strict=True):
            own = model.sums(model.design(x[~kept]), y[~kept], bound=True)
            weight = min(1.0, (~kept).sum() / n) if n else 0.0
            model.step(own[0] + weight * gradient, own[1] + weight * curvature)
    odds = np.column_stack([m.odds(x[kept]) for m, x in zip(models, sides, strict=True)])
    return CoTrained(models[0], models[1], Logistic(odds, y[kept]), rate)


_META = ("source", "lang", "n_chars")


def _views(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    meta = [batch.column(names.index(c)).to_pylist() if c in names else [None] * batch.num_rows for c in _META]
    return content_features(batch.column(names.index("text"))), metadata_features(*meta)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_labelled: int = 6000, rounds: int = 3, sure: float = 0.95) -> CoTrained:
    used = [c for c in ("text", *_META) if c in docs.columns]
    usable = labels.select(key, F.col(label).alias("label")).where(F.col("label").isin(0, 1)).groupBy(key).agg(F.max("label").cast("int").alias("label"))
    chosen = sample_ids(usable, key, max_labelled)
    rows = docs.select(*[F.col(c) for c in dict.fromkeys((key, *used))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, meta = _views(batch, used)
            yield pa.RecordBatch.from_arrays([batch.column(len(used)), batch.column(len(used) + 1), pa.array(content.tolist(), pa.list_(pa.float64())), pa.array(meta.tolist(), pa.list_(pa.float64()))], names=["place", "label", "content", "meta"])

    labelled = with_texts(rows, chosen.withColumnRenamed("label", "__label"), key).select(*used, F.xxhash64(key).alias("place"), F.col("__label").alias("label"))
    got = labelled.mapInArrow(measure, "place long, label int, content array<double>, meta array<double>").toPandas()
    got = got.sort_values("place", kind="stable")
    sides = tuple(np.array(got[c].tolist(), float).reshape(len(got), width) for c, width in (("content", CONTENT), ("meta", META)))

    def pool(views: list[View]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        shared = docs.sparkSession.sparkContext.broadcast(views)
        sizes = [len(v.model.w) for v in views]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(1 + d + d * d for d in sizes))
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    total += np.concatenate([np.concatenate(([n], g, c.ravel())) for n, g, c in pool_sums(shared.value, _views(batch.slice(at, 512), used), sure)])
            yield pa.record_batch({"slot": pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        def added(part: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(s) for s in part["sums"]], axis=0)
            return pd.DataFrame({"sums": [total.tobytes()]})

        # Sums meet in a few tasks before the driver adds up at most SLOTS of them.
        parts = rows.select(*used).mapInArrow(add, "slot int, sums binary").groupBy("slot").applyInPandas(added, "sums binary").collect()
        total = np.sum([np.frombuffer(r["sums"]) for r in parts], axis=0) if parts else np.zeros(sum(1 + d + d * d for d in sizes))
        out = []
        for d in sizes:
            own, total = total[: 1 + d + d * d], total[1 + d + d * d :]
            out.append((int(own[0]), own[1 : 1 + d], own[1 + d :].reshape(d, d)))
        return out

    return co_train(sides, got["label"].to_numpy(float), pool, rounds)


def score(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """``docs`` with quality_score (0 to 1) and keep (score of at least ``threshold``)."""
    others = [c for c in docs.columns if c not in ("quality_score", "keep")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = shared.value.score(*_views(part, others))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array(scores >= threshold)], names=[*others, "quality_score", "keep"])

    kind = T.StructType([*[docs.schema[c] for c in others], T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return docs.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(rate, kind)
