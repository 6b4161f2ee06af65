"""Control-flow paths, slices and entry cascades beside plain walks."""

import random

import pytest

from tidemark.operators import flows


def plain_paths(nodes, edges, max_paths, max_depth, visits):
    start = next(n for n, k in nodes.items() if k == "START")
    end = next(n for n, k in nodes.items() if k == "END")
    out = {}
    for e in sorted(edges, key=lambda e: e[3]):
        out.setdefault(e[0], []).append(e)

    def prob(e):
        if e[4] is not None:
            return max(1e-12, min(1.0, e[4]))
        kind, label = nodes.get(e[0]), (e[2] or "").lower()
        table = {("IF", "then"): 0.5, ("IF", "else"): 0.5, ("LOOP_HDR", "repeat"): 0.6, ("LOOP_HDR", "exit"): 0.4}
        return 1 / len(out[e[0]]) if kind == "SWITCH" else table.get((kind, label), 1.0)

    found, left = [], [([start], [], 1.0)]
    while left:
        path, places, p = left.pop()
        if path[-1] == end:
            found.append((path, p))
            continue
        if len(path) > max_depth:
            continue
        here = out.get(path[-1], [])
        if nodes.get(path[-1]) in ("LOOP", "LOOP_HDR") and path.count(path[-1]) > visits:
            here = [e for e in here if (e[2] or "").lower() in ("exit", "false", "break", "no_else")]
        for e in reversed(here):
            first = next(f for f in out[e[0]] if f[1] == e[1])
            left.append(([*path, e[1]], [*places, e[3]], p * prob(first)))
    return found


def graphs():
    straight = {"s": "START", "e": "END"}, [("s", "e", None, 0, None)]
    looped = (
        {"s": "START", "i": "IF", "a": "CALL", "b": "CALL", "l": "LOOP_HDR", "w": "SWITCH", "x": "CALL", "y": "CALL", "z": "CALL", "e": "END"},
        [("s", "i", "", 0, None), ("i", "a", "Then", 0, None), ("i", "b", "else", 1, 0.25), ("a", "l", None, 0, None), ("b", "l", None, 0, None), ("l", "w", "repeat", 0, None), ("l", "e", "exit", 1, None)]
        + [("w", v, v, k, None) for k, v in enumerate("xyz")] + [(v, "l", None, 0, None) for v in "xyz"],
    )
    dead = {"s": "START", "d": "CALL", "t": "CALL", "e": "END"}, [("s", "d", None, 0, None), ("s", "t", None, 1, 7.0), ("s", "e", None, 2, None), ("t", "e", None, 0, None), ("t", "e", "again", 1, 0.5)]
    chain = {"s": "START", "e": "END"} | {f"{c}{k}": "IF" if c == "i" else "CALL" for k in range(12) for c in "iab"}, [("s", "i0", None, 0, None)]
    for k in range(12):
        after = f"i{k + 1}" if k < 11 else "e"
        chain[1].extend([(f"i{k}", f"a{k}", "then", 0, None), (f"i{k}", f"b{k}", "else", 1, None), (f"a{k}", after, None, 0, None), (f"b{k}", after, None, 0, None)])
    stuck = {"s": "START", "l": "LOOP", "e": "END"}, [("s", "l", None, 0, None), ("l", "l", "repeat", 0, None)]
    nested = {"s": "START", "l": "LOOP_HDR", "m": "LOOP_HDR", "e": "END"}, [("s", "l", None, 0, None), ("l", "m", "repeat", 0, None), ("m", "m", "repeat", 0, None), ("m", "l", "exit", 1, None), ("l", "e", "exit", 1, None)]
    return {1: straight, 2: looped, 3: dead, 4: chain, 5: stuck, 6: nested}


@pytest.mark.parametrize(("max_paths", "max_depth"), [(100, 1000), (5, 1000), (7, 9)])
def test_paths_equal_a_plain_walk(spark, max_paths, max_depth):
    all_ = graphs()
    nodes = spark.createDataFrame([(g, n, k) for g, (ns, _) in all_.items() for n, k in ns.items()], "graph int, node string, kind string")
    edges = spark.createDataFrame([(g, *e) for g, (_, es) in all_.items() for e in es], "graph int, src string, dst string, label string, place int, measured double")
    paths, whole = flows.control_paths(nodes, edges, max_paths, max_depth)
    got = {}
    for r in sorted(paths.collect(), key=lambda r: (r["graph"], r["rank"])):
        got.setdefault(r["graph"], []).append((list(r["path"]), r["probability"]))
    truncated = {r["graph"]: r["truncated"] for r in whole.collect()}
    for g, (ns, es) in all_.items():
        if g == 4 and max_depth == 9:
            assert g not in got and truncated[g]
            continue
        want = plain_paths(ns, es, max_paths, max_depth, 2)
        assert [p for p, _ in got.get(g, [])] == [p for p, _ in want[:max_paths]], g
        assert [p for _, p in got.get(g, [])] == pytest.approx([p for _, p in want[:max_paths]])
        if len(want) > max_paths:
            assert truncated[g]
    assert not truncated[1] and (max_paths < 100 or not truncated[2])


def test_slices(spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}", rng.choice(["CALLS", "CALLS", None, "IMPORTS"])) for _ in range(40)]
    edges = spark.createDataFrame([*rows, ("end", "last", "CALLS")], "src string, dst string, relation string")
    seeds = ["n0", "n3", "end", "absent"]
    for depth in (0, 1, 2, 20):
        got, told = flows.slices(edges, spark.createDataFrame([(s,) for s in seeds], "node string"), depth)
        calls = [(a, b) for a, b, r in [*rows, ("end", "last", "CALLS")] if r != "IMPORTS"]
        want, flags = [], {}
        for seed in seeds:
            far, level = {seed: 0}, [seed]
            for d in range(1, depth + 1):
                level = sorted({b for a, b in calls if a in level and b not in far})
                far |= dict.fromkeys(level, d)
            mine = [(seed, a, b, far[b] <= far[a]) for a, b in calls if far.get(a, depth) < depth]
            want += mine
            flags[seed] = (len(far), len(mine), any(far.get(a) == depth for a, _ in calls))
        assert sorted((r["seed"], r["src"], r["dst"], r["closes"]) for r in got.collect()) == sorted(want)
        assert {r["seed"]: (r["n_nodes"], r["n_edges"], r["truncated"]) for r in told.collect()} == flags


def test_entry_cascade(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "node string")
    rows = [(1, 0, "zz"), (1, 1, "b"), (1, 1, "a"), (1, 2, "c"), (2, 0, "f"), (2, 1, "a"), (3, 0, "q"), (4, 3, "c"), (4, 3, "a"), (4, 3, "b"), (4, 3, "b"), (5, 1, None)]
    got = flows.entry_cascade(spark.createDataFrame(rows, "request int, tier int, id string"), nodes, {3: 2}).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (1, 1, "b"), (2, 0, "f"), (4, 3, "a"), (4, 3, "b")]
