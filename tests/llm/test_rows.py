"""Search, chat format, sharding and the classifiers."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import chat_format, quality, sharding, topk_search, toxicity


def brute_top(rows, k):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, tuple(math.floor(64 * x) for x in v)))
    out = []
    for q, a in dict.fromkeys(usable):
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in usable if c != q)
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(4)
    for size in (64, 3):
        rows = [(i, [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) for _ in range(size)]) for i in range(300)]
        rows += [rows[7], rows[20], (301, None), (302, []), (303, [float("nan")] * size), (304, [None] * size), (None, rows[1][1]), (305, [float("inf")] + [0.0] * (size - 1)), (320, [2.0])]
        frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
        got = topk_search.top_k(frame, k=5, block_rows=90)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)
    assert topk_search.top_k(spark.createDataFrame([], frame.schema)).collect() == []


def test_top_k_beyond_doubles(spark):
    rows = [(0, [3e15, 1.0]), (1, [3e15, 1.0]), (2, [2.0, 1.0]), (3, [-3e15, 0.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    big = 64 * 3 * 10**15
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (2, min(2**63 - 1, big * 128 + 64 * 64)), (3, -(2**63))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\[INST]\\\\", "<<SYS>><</SYS>>", "[/TURN][/ROLE]", "", None, "<<s>s>", "a\nb"]
    rows = [(-1, 0, "user", hostile[0]), (-1, 1, "assistant", hostile[0])]
    rng = random.Random(2)
    for conv in range(30):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "[/ROLE]", None]), rng.choice(hostile)))
    rows += [rows[5], (None, 0, "user", "hi")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = {r["conv_id"]: r for r in chat_format.format_and_read(turns).collect()}
    segments = chat_format.format_turns(turns)
    again = {r["conv_id"]: r for r in chat_format.read_back(segments).collect()}
    assert got == again and set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        before, fine = None, True
        for _, role, _ in own:
            fine &= (role in ("system", "user")) if before is None else (before, role) in {("system", "user"), ("user", "assistant"), ("assistant", "user")}
            before = role
        assert r["in_order"] == fine
    text = "".join(s["segment"] for s in sorted(segments.where("conv_id = -1").collect(), key=lambda s: s["seq"]))
    assert got[-1]["formatted_chars"] == len(text) and text.count("[INST]") == 1
    assert chat_format.format_and_read(spark.createDataFrame([], turns.schema)).collect() == []


def test_shards_fit(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, rng.choice([1, 10, 500]), "x") for k in range(400)] + [(7, 90, "x")] * 60 + [(None, 5, "x"), (401, None, "x"), (402, 5000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, n_bytes long, shard string")
    got = sharding.assign_shards(frame, "doc_id", F.col("n_bytes"), 1000).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["n_bytes"] or 0)
    for r in got:
        assert (r["shard_bytes"], r["shard_rows"]) == (sum(shards[r["shard"]]), len(shards[r["shard"]]))
    assert all(sum(s) <= 1000 or len(s) == 1 for s in shards.values())
    names = sorted(shards)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    # Only oversized prefixes are split: siblings together exceed the limit.
    for a in names:
        above = [x for n, s in shards.items() if n.startswith(a[:-1]) for x in s]
        assert not a or sum(above) > 1000
    assert sharding.assign_shards(frame.limit(0), "doc_id", F.col("n_bytes"), 1000).collect() == []
    joined = sharding.assign_shards(frame, "doc_id", F.col("n_bytes"), 1000, sent_rows=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))
    path = str(tmp_path / "shards")
    sharding.write_shards(spark.createDataFrame(got, "doc_id long, n_bytes long, shard string, shard_bytes long, shard_rows long"), path)
    back = spark.read.parquet(path).collect()
    assert sorted((r["shard"], r["n_bytes"] or 0) for r in back) == sorted(("s" + r["shard"], r["n_bytes"] or 0) for r in got)


def labelled(spark, n=600):
    rng = random.Random(8)
    plain, bad = [f"word{k}" for k in range(200)], ["idiot", "scum", "moron"]
    rows, labels = [], []
    for d in range(n):
        toxic, poor = rng.random() < 0.2, rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(40)]
        if poor:
            words = [words[0]] * 30 + words[:5]
        if toxic:
            words[5:5] = rng.sample(bad, 2)
        rows.append((d, " ".join(words), "en", f"src{d % 3}", 9))
        labels.append((d, int(not poor), int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), rows[0]]
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit(docs, labels, max_examples=60)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    expected = {d: t for d, _, t in truth}
    held = [r for r in got if r["held_out"] and r["doc_id"] in expected]
    assert sum(r["predicted"] == expected[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    # Block-max search finds the same neighbours as all cosines do.
    index = model.index
    weights = np.zeros((len(index.ids), len(model.terms)))
    for term in range(len(model.terms)):
        for n in range(index.lists[term], index.lists[term + 1]):
            some = slice(index.begin[n], index.begin[n] + index.size[n])
            assert index.most[n] == index.weight[some].max() and (index.owner[some] // toxicity.BLOCK == index.block[n]).all()
            weights[index.owner[some], term] = index.weight[some]
        if index.column[term] >= 0:
            weights[:, term] = index.dense[index.column[term], : len(weights)]
    assert np.allclose((weights**2).sum(1), 1)
    for _, place, times in toxicity.vectors(pa.array([r["text"] for r in docs.collect()]), model.terms):
        w = index.weights(place, times)
        at, cosines = index.nearest(place, w, index.known([(place, w)])[0], 5)
        every = weights[:, place] @ w
        best = [i for i in np.lexsort((np.arange(len(every)), -every.round(9)))[:5] if every[i] > 0]
        assert len(at) == len(best) and np.allclose(cosines, every[best]) and np.allclose(every[at], every[best])
    nothing = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r[0] for r in nothing] == [0.0]
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []


def test_isotonic_rises():
    ends, rates = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1, 0, 1, 1]))
    assert ends.tolist() == [0.1, 0.3, 0.5] and rates.tolist() == [0.0, 0.5, 1.0]
    for y in ([0.0, 1.0], [1.0, 0.0]):  # ties are one point
        ends, rates = toxicity.isotonic(np.array([0.5, 0.5]), np.array(y))
        assert ends.tolist() == [0.5] and rates.tolist() == [0.5]


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    unseen = [(d, q) for d, q, _ in truth if d % 2]
    assert sum(got[d]["keep"] == bool(q) for d, q in unseen) >= 0.95 * len(unseen)
    assert quality.score(docs, model).columns[-2:] == ["quality_score", "keep"]
    assert {r["quality_score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {1.0}
    empty = docs.limit(0)
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).collect() == []


def test_long_texts_and_clashing_columns(spark):
    """Very long texts, ties in votes, and columns that are named like those of results."""
    n = 200_000
    texts = [" " * n, "a" * n, "!?" * (n // 2), "one " * (n // 4), "é" * (n // 2), None, ""]
    texts += [f"word{k % 7} word{k % 11} idiot" if k % 2 else f"word{k % 7} word{k % 11} fine" for k in range(60)]
    rows = [(d, t, "en", "s", 1, 0.5, True, "x", "y") for d, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality_score double, keep boolean, label string, evidence string")
    labels = spark.createDataFrame([(d, int(d % 2 == 0), d % 2) for d in range(7, len(texts))], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit(docs, labels))
    assert scored.columns == [*(c for c in docs.columns if c not in ("quality_score", "keep")), "quality_score", "keep"] and scored.count() == len(texts)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels, max_examples=20)).collect()}
    assert [got[d] for d in range(7, len(texts))] == [d % 2 for d in range(7, len(texts))]
    turns = docs.select((F.col("doc_id") % 3).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    read = {r["conv_id"]: r["turns_sha256"] for r in chat_format.format_and_read(turns).collect()}
    assert read == {c: sha("".join(f"user\n{t or ''}\n" for d, t in enumerate(texts) if d % 3 == c)) for c in range(3)}
