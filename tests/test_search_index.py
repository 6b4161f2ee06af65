"""The kept index beside a plain BM25: searches, bounds and updates."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest

from tidemark.operators import search, search_index


def plain(docs, queries, k, k1=1.5, b=0.75):
    bags = {d: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for d, t in docs.items()}
    avg = sum(c.total() for c in bags.values()) / max(1, len(bags))
    df = Counter(t for c in bags.values() for t in c)
    out = []
    for q, text in queries.items():
        scores = {}
        for t in set(re.findall("[a-z0-9]+", (text or "").lower())):
            idf = math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5))
            for d, c in bags.items():
                if c[t]:
                    scores[d] = scores.get(d, 0) + idf * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * c.total() / avg))
        ranked = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out += [(q, d, n, pytest.approx(s, abs=2e-6)) for n, (d, s) in enumerate(ranked, 1)]
    return out


def found(index, queries, spark, k=10):
    rows = search_index.search(index, spark.createDataFrame(list(queries.items()), "query_id long, text string"), k).collect()
    return [(r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in sorted(rows, key=lambda r: (list(queries).index(r["query_id"]), r["rank"]))]


def texts(rng, n):
    # Words of falling frequency: the first is in nearly all texts.
    words = [f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    return {k: " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 60]))) for k in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def test_index_equals_plain_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK_DOCS", 7)
    rng = random.Random(1)
    docs = texts(rng, 400) | {1000: None, 1001: "", 1002: "W0 w0, W1!", 1003: "x" * 100_000, 1004: "w3 " * 50_000}
    queries = {1: "w0 w90", 2: "w1 w2 w110 w111", 3: "W50", 4: "nothing here", 5: "", 6: None, 7: "w0", 8: " ".join(f"w{k}" for k in range(40)), 9: "w0 w0 w0 w119"}
    rows = frame(spark, docs).union(spark.createDataFrame([(None, "w0 w1")], "doc_id long, text string"))
    index = search_index.build(rows.repartition(3), f"{tmp_path}/index", buckets=8)
    assert index.blocks > 50
    for k in (1, 3, 10):
        assert found(index, queries, spark, k) == plain(docs, queries, k)
    again = search_index.load(spark, f"{tmp_path}/index")
    assert (again.buckets, again.blocks) == (8, index.blocks) and found(again, {2: queries[2]}, spark) == plain(docs, {2: queries[2]}, 10)
    assert search_index.search(index, spark.createDataFrame([], "query_id long, text string")).collect() == []


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_update_rewrites_only_its_buckets(spark, tmp_path):
    rng = random.Random(2)
    docs = texts(rng, 200)
    path = f"{tmp_path}/index"
    index = search_index.build(frame(spark, docs), path, buckets=64)
    before = files(f"{path}/postings")
    fresh = {k: f"w{k} only{k}" for k in range(5)} | {5: "", 300: "fresh w1", 301: None}
    touched = search_index.update(index, frame(spark, fresh), frame(spark, {7: "", 9999: ""}).select("doc_id"))
    after = files(f"{path}/postings")
    of = lambda names: {int(n.split("/")[0].removeprefix("bucket=")) for n in names}
    changed = {n for n in before.keys() | after.keys() if before.get(n) != after.get(n)}
    assert of(changed) == set(touched) and len(touched) < 64
    docs |= fresh
    del docs[7]
    queries = {1: "w0 w90", 2: "w1 w2 w110", 3: "only3 only4", 4: "fresh", 5: "w3 w4"}
    assert found(index, queries, spark) == plain(docs, queries, 10)
    # A bucket may lose all its documents, and the index too.
    search_index.update(index, frame(spark, {}), frame(spark, docs).select("doc_id"))
    assert found(index, queries, spark) == [] and index.documents().count() == 0
    search_index.update(index, frame(spark, {1: "w1"}))
    assert [r[:3] for r in found(index, {1: "w1"}, spark)] == [(1, 1, 1)]


def test_empty_index(spark, tmp_path):
    index = search_index.build(frame(spark, {}), f"{tmp_path}/index", buckets=4)
    assert found(index, {1: "a"}, spark) == []


def test_nearest_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 7)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rng = random.Random(3)
    rows = {k: [rng.choice([0.0, 1.0, 0.5]) for _ in range(3)] for k in range(60)}
    data = spark.createDataFrame([(k, v, k % 2) for k, v in rows.items()] + [(100, None, 0), (101, [], 0), (102, [1.0, None, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    asked = data.where("vec_id % 10 = 0 OR vec_id > 99")
    for subset, apart in ((None, True), ("label", True), (None, False)):
        got = search.nearest(data, asked, k=4, subset=subset, apart=apart).collect()
        want = []
        for q in range(0, 60, 10):
            scored = [(-round(sum(a * b for a, b in zip(rows[q], v, strict=True)), 5), k) for k, v in rows.items() if (k != q or not apart) and (not subset or k % 2 == q % 2)]
            want += [(q, k, -s, n) for n, (s, k) in enumerate(sorted(scored)[:4], 1)]
        assert sorted((r["query_id"], r["vec_id"], r["cosine"], r["rank"]) for r in got) == sorted(want)
    assert search.nearest(data.limit(0), asked).collect() == [] and search.nearest(data, asked.limit(0)).collect() == []


def test_tasks_of_the_index_grow_with_its_blocks(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    parts = lambda blocks: search_index._grouped(search_index._postings(search_index._counted(rows), (i := search_index.SearchIndex(spark, "", 4, blocks))), i)
    assert "hashpartitioning" in parts(64)._jdf.queryExecution().toString()
    n = lambda blocks: int(re.search(r"RepartitionByExpression \[[^\]]*\], (\d+)", parts(blocks)._jdf.queryExecution().toString())[1])
    assert (n(256), n(2560), n(256000)) == (4, 40, 4000)
