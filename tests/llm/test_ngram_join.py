import random

import pyarrow as pa
import pytest

from tidemark.llm import ngram_join, wordhash


def words(text):
    table = {c: c + 32 for c in range(65, 91)}
    return [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))]


def shingle_set(text, size=4):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", "  \t\n", "One", "one", "a b", "A B", "a b c d", "a b c d e"]
    for length in (5, 8, 12, 20, 40, 80, 150, 400):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(length)]
            texts.append(" ".join(base))
            for _ in range(8):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, length // 25))):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " \n".join(copy))
    texts += texts[:12]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, component_id string")
    got = ngram_join.jaccard_components(docs, block=4)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def passages(seed):
    """Texts with a passage that most of them share, though few link."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    texts = [" ".join([*(f"t{d}x{k}" for k in range(10)), *passage, *(f"u{d}x{k}" for k in range(10))]) for d in range(120)]
    texts += [text.replace("x3 ", "y ", 1) for text in texts[:30]] + [" ".join(passage), " ".join([*passage, "q1"])]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_shared_passages_make_no_large_clusters(spark, monkeypatch):
    """Sets that only share a passage aren't dealt to blocks by the square of their number."""
    sizes, product = [], ngram_join.linked_sets

    def seen(grams, near, percent, block):
        sizes.extend(r["count"] for r in near.groupBy("cluster").count().collect())
        return product(grams, near, percent, block)

    monkeypatch.setattr(ngram_join, "linked_sets", seen)
    rows = passages(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, block=8).collect())) == brute(rows)
    assert 2 <= max(sizes) <= 8


def test_sets_of_one_short_name_are_compared(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BITS", 8)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, block=16).collect())) == brute(rows)


def test_prefixes_of_linked_sets_meet():
    import numpy as np

    rng = np.random.default_rng(7)
    for percent in (50, 80, 85, 100):
        for size in [1, 2, 5, 19, 20, 21, 100]:
            for _ in range(40):
                base = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
                over = rng.integers(1, size + 1)
                x, y = np.sort(base[:size]), np.sort(np.concatenate([base[:over], base[size : size + rng.integers(0, size + 1)]]))
                common = np.sort(rng.choice(base, rng.integers(0, len(base) + 1), replace=False))
                times = rng.integers(8, 12, len(common))
                if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
                    assert len(np.intersect1d(*(ngram_join.prefix(z, percent, common, times) for z in (x, y))))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(docs).collect() == []


def test_parts_of_linked_sets_meet():
    """Signatures alone must bring every linked pair together, at sizes where parts run empty, too."""
    import numpy as np

    rng = np.random.default_rng(5)
    classes = ngram_join.SizeClasses(85)
    for size in [2, 3, 6, 7, 9, 13, 30, 100, 700]:
        for _ in range(60):
            base = rng.integers(0, 2**63, size + size // 2, dtype=np.uint64)
            x, low = np.sort(base[:size]), ngram_join.needed(2 * size, 85)
            for over in range(low, size + 1):
                y = np.sort(np.concatenate([base[:over], base[size : size + size - over]]))
                both = len(np.intersect1d(x, y))
                common = np.sort(rng.choice(base, rng.integers(0, len(base) + 1), replace=False))
                if 185 * both >= 85 * (len(x) + len(y)) and both < size:
                    assert len(np.intersect1d(ngram_join.signatures(x, classes, common), ngram_join.signatures(y, classes, common)))


def test_long_texts_hash_as_in_pieces(monkeypatch):
    text = " ".join(f"Word{k % 37}" for k in range(500)) + " " + "x" * 300
    whole = [h.tolist() for _, _, h in wordhash.hash_texts(pa.array([text]))]
    monkeypatch.setattr(wordhash, "PIECE", 64)
    cut = [h.tolist() for _, _, h in wordhash.hash_texts(pa.array([text]))]
    assert whole == cut and len(whole[0]) == 501
