"""Communities by modularity: planted ones, a star, and the value itself."""

import random
from itertools import combinations

import pytest

from tidemark.operators import graph, modularity


def plain(pairs, label):
    links = {frozenset(p) for p in pairs if p[0] != p[1]}
    degree = {}
    for a, b in map(tuple, links):
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    m = len(links)
    inner = sum(label[a] == label[b] for a, b in map(tuple, links)) / m
    totals = {}
    for n, k in degree.items():
        totals[label[n]] = totals.get(label[n], 0) + k
    return inner - sum((k / (2 * m)) ** 2 for k in totals.values())


def edges(spark, pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_planted_parts(spark):
    rng = random.Random(1)
    part = {f"n{k:02}": k % 3 for k in range(45)}
    pairs = [(a, b) for a, b in combinations(part, 2) if rng.random() < (0.6 if part[a] == part[b] else 0.04)]
    pairs += [(b, a) for a, b in pairs[:20]] + [pairs[0], ("n00", "n00"), ("loop", "loop")]
    given = edges(spark, pairs).repartition(3)
    labels, value = modularity.communities(given)
    got = {r["node"]: r["community"] for r in labels.collect()}
    assert got == {n: f"n0{k}" for n, k in part.items()}
    assert value == pytest.approx(plain(pairs, got)) and modularity.modularity(given, labels) == pytest.approx(value)


def test_a_star_and_cliques(spark):
    star = edges(spark, [("hub", f"leaf{k}") for k in range(12)])
    labels, value = modularity.communities(star)
    assert labels.count() == 13
    assert value >= modularity.modularity(star, graph.communities(star)) - 1e-9
    two = [(f"{c}{a}", f"{c}{b}") for c in "xy" for a, b in combinations(range(5), 2)] + [("x0", "y0")]
    labels, value = modularity.communities(edges(spark, two))
    assert {r["node"]: r["community"] for r in labels.collect()} == {f"{c}{k}": f"{c}0" for c in "xy" for k in range(5)}
    assert value == pytest.approx(plain(two, {f"{c}{k}": c for c in "xy" for k in range(5)}))
    none, value = modularity.communities(edges(spark, [("a", "a")]))
    assert (none.collect(), value) == ([], 0.0)
