"""Work that must grow with the input: rows that the steps of a plan make, against plain results."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import codegraph, components, flows, graph, modularity, schemas, search, spread, trees
from tidemark.operators.components import connected_components
from tests.test_search_index import frame, plain, texts


def rows_made(spark, run):
    """What ``run`` returns, and the most rows that any step of its plans made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    made, found = 0, store.executionsList()
    for at in range(before, found.size()):
        one = found.apply(at).executionId()
        values, nodes = store.executionMetrics(one), store.planGraph(one).allNodes()
        for metrics in (nodes.apply(k).metrics() for k in range(nodes.size())):
            for metric in (metrics.apply(k) for k in range(metrics.size())):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made = max(made, int(re.sub(r"\D", "", str(values.apply(metric.accumulatorId())).split("\n")[-1].split("(")[0]) or 0))
    return out, made


def rows_shuffled(spark, run):
    """What ``run`` returns, and how many rows its stages shuffled."""
    store = spark._jsc.sc().statusStore()

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None).iterator()
        total = 0
        while stages.hasNext():
            total += stages.next().shuffleWriteRecords()
        return total

    before = written()
    return run(), written() - before


def bytes_from_python(spark, run):
    """What ``run`` returns, and how many bytes the Python workers of its plans gave back."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    size, found = 0.0, store.executionsList()
    for at in range(before, found.size()):
        one = found.apply(at).executionId()
        values, nodes = store.executionMetrics(one), store.planGraph(one).allNodes()
        for metrics in (nodes.apply(k).metrics() for k in range(nodes.size())):
            for metric in (metrics.apply(k) for k in range(metrics.size())):
                if metric.name() == "data returned from Python workers" and values.contains(metric.accumulatorId()):
                    number, unit = re.search(r"([\d.]+) (\w*B)", str(values.apply(metric.accumulatorId())).split("\n")[-1]).groups()
                    size += float(number) * 1024 ** ("B", "KiB", "MiB", "GiB").index(unit)
    return out, size


def test_best_callees_meet_no_whole_names(spark):
    rng = random.Random(3)
    symbols = [(f"{rng.choice(['a', 'bb'])}/f{k % 7}::{'same' if k % 5 else 'x'}{k}", "same" if k % 3 else f"n{k % 4}", rng.choice([f"f{k % 7}", None])) for k in range(900)]
    symbols += [("z::same", "same", "f9"), ("a::q", None, "f1")]
    calls = [(f"c{k}", rng.choice(["same", "n1", "n2", "none", None]), rng.choice([*(f"f{j}" for j in range(10)), None])) for k in range(800)]
    calls += [("c0", "same", "f1"), ("c0", "n1", "f2")]
    want = {}
    for call, label, file in calls:
        for one, name, in_file in symbols:
            if label is not None and name == label:
                rank = (-(2 * (in_file is not None and in_file == file) + (one.rsplit("::", 1)[-1] == label)), len(one), one)
                want[call] = min(want.get(call, rank), rank)
    run = lambda: codegraph.best_callees(spark.createDataFrame(calls, "call string, label string, file_path string"), spark.createDataFrame(symbols, "id string, method_name string, file_path string")).collect()
    got, made = rows_made(spark, run)
    assert {r["call"]: r["callee"] for r in got} == {c: rank[2] for c, rank in want.items()} and len(got) == len(want)
    assert len(symbols) <= made <= len(symbols) + len(calls)


def test_a_pass_of_modularity_is_two_executions(spark):
    rng = random.Random(5)
    pairs = [(f"b{rng.randrange(20)}", f"t{rng.randrange(40)}") for _ in range(900)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    store = spark._jsparkSession.sharedState().statusStore()

    def executions(passes):
        before = store.executionsCount()
        modularity.communities(edges, passes=passes, levels=1)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return store.executionsCount() - before

    assert executions(6) - executions(2) <= 2 * 4


def tasks_of(frame):
    return frame.rdd.getNumPartitions()


def test_graph_tasks_grow_with_the_edges(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 500)
    monkeypatch.setattr(spread, "HUB_ROWS", 100)
    rng = random.Random(7)
    hub = [("zz", f"a{k:04}") for k in range(1500)] + [("a0000", f"b{k}") for k in range(300)]
    chains = [(f"c{k}", f"c{k + 1}") for k in range(20)] + [(f"d{rng.randrange(50)}", f"d{rng.randrange(50)}") for _ in range(40)]
    edges = spark.createDataFrame([*hub, *chains, ("loop", "loop")], "src string, dst string")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in map(tuple, edges.collect()):
        low, high = sorted((find(a), find(b)))
        top[high] = low
    assert got == {n: find(n) for n in top}
    labels = graph.communities(edges, rounds=2)
    weight, want = {}, {n: n for n in top if n != "loop"}
    for a, b in map(tuple, edges.collect()):
        if a != b:
            weight[a, b], weight[b, a] = weight.get((a, b), 0) + 1, weight.get((b, a), 0) + 1
    for n in want:
        weight[n, n] = 1
    for _ in range(2):
        votes = {}
        for (a, b), w in weight.items():
            votes.setdefault(a, {}).setdefault(want[b], 0)
            votes[a][want[b]] += w
        want = {n: min((-v, c) for c, v in votes[n].items())[1] for n in want}
    assert {r["node"]: r["community"] for r in labels.collect()} == want
    assert tasks_of(labels) >= len(hub) // 500


def test_components_shuffle_fewer_rows_than_there_are_edges(spark):
    rng = random.Random(11)
    pairs = [(f"p{rng.randrange(400)}", f"s{rng.randrange(90)}") for _ in range(20_000)] + [(f"q{k}", f"q{k + 1}") for k in range(50)]
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(4)
    got, shuffled = rows_shuffled(spark, lambda: {r["node"]: r["component"] for r in connected_components(edges.localCheckpoint()).collect()})
    assert got == {n: "q0" if n[0] == "q" else "p0" for pair in pairs for n in pair}
    assert shuffled - len(pairs) < len(pairs)  # dealing out the edges is a shuffle of the test's own


def test_rounds_of_communities_shuffle_the_links_once(spark):
    rng = random.Random(17)
    pairs = [(f"p{rng.randrange(300)}", f"s{rng.randrange(60)}") for _ in range(4000)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    links, nodes = 2 * len(set(pairs)), len({n for pair in pairs for n in pair})
    tables = spark.catalog.listTables()
    (first, one), (again, two) = (rows_shuffled(spark, lambda r=r: graph.communities(edges, rounds=r).collect()) for r in (1, 2))
    assert one <= 2 * len(pairs) + 10 and len(first) == len(again) == nodes
    # A round sends a vote a link and node, what its 16 parts found, and the labels.
    assert two - one <= links + (1 + 16 + 1) * nodes
    assert spark.catalog.listTables() == tables


@pytest.mark.parametrize("kind", ["chain", "dense", "loops"])
def test_components_of_edges_in_many_chunks(spark, monkeypatch, kind):
    monkeypatch.setattr(components, "CHUNK", 40)
    monkeypatch.setattr(spread, "HUB_ROWS", 20)
    rng = random.Random(13)
    names = rng.sample(range(-300, 300), 400)
    pairs = {"chain": list(zip(names, names[1:])), "dense": [(rng.choice(names), rng.choice(names)) for _ in range(420)], "loops": [(n, n) for n in names[:60]] * 2}[kind]
    top = {n: n for pair in pairs for n in pair}
    for _ in names:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    edges = spark.createDataFrame([*pairs, (None, 1), (2, None)], "src long, dst long").repartition(4)
    got = connected_components(edges).collect()
    assert {r["node"]: r["component"] for r in got} == top and len(got) == len(top)


@pytest.mark.parametrize("block", [512, 3])
def test_bm25_of_fresh_texts_makes_no_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_QUERIES", block)
    monkeypatch.setattr(search, "SLAB", 16)
    docs = texts(random.Random(1), 400) | {1000: None, 1001: "", 1002: "W0 w0, W1!", 1003: "x" * 100_000, 1004: "w3 " * 50_000, 1005: "w7 w7", 1006: "w7 w7"}
    queries = {1: "w0 w90", 2: "w1 w2 w110 w111", 3: "W50", 4: "nothing here", 5: "", 6: None, 7: "w0", 8: " ".join(f"w{k}" for k in range(40)), 9: "w0 w0 w0 w119", 10: "w7"}
    queries |= {k: "w0 w1 w2" for k in range(20, 60)}
    rows = frame(spark, docs).union(spark.createDataFrame([(None, "w0 w1")], "doc_id long, text string")).repartition(3)
    asked = frame(spark, queries).withColumnRenamed("doc_id", "query_id")
    got, made = rows_made(spark, lambda: search.bm25(rows, asked).collect())
    assert [(r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == plain(docs, queries, 10)
    # Forty queries share the commonest words, so that their pairs with documents are more than 10,000.
    assert made <= 3 * 10 * len(queries)
    assert search.bm25(rows.limit(0), asked).collect() == [] and search.bm25(rows, asked.limit(0)).collect() == []


def test_word_shapes_make_a_row_a_text(spark):
    docs = {k: " ".join(f"{chr(97 + k % 26)}{j}" for j in range(k)) for k in range(60)} | {100: None}
    got, made = rows_made(spark, lambda: search.word_shapes(frame(spark, docs), "doc_id").collect())
    assert {r["doc_id"] for r in got} == set(range(1, 60)) and made <= len(docs)
    assert [round(x, 6) for x in got[11]["vector"] if x] == [round(v / (10 * 10 + 2 * 2) ** 0.5, 6) for v in (10, 2)]


def test_markdown_stays_in_its_row(spark):
    texts_ = [json.dumps({"a": {"b": k}, "t": [{"k": 1}, {"k": 2}], "l": [[1, [2]], {"x": []}]}) for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "id long, text string")
    got, made = rows_made(spark, lambda: trees.json_markdown(docs, "id").collect())
    assert len(got) == 50 and made <= 50 and "Exchange" not in trees.json_markdown(docs, "id")._jdf.queryExecution().toString()
    assert {r["text"] for r in got if r["id"] == 7} == {"## A\n- **B:** 7\n\n## T\n\n| K |\n| --- |\n| 1 |\n| 2 |\n\n## L\n- [1, [2]]\n\n### X"}
    rows = spark.createDataFrame([(k, f"<a><b x='{k}'><c>1</c></b><b><c>2</c></b></a>") for k in range(50)], "id long, text string")
    got, made = rows_made(spark, lambda: trees.xml_markdown(rows, "id").collect())
    assert len(got) == 50 and made <= 50 and {r["text"] for r in got} == {"## A\n\n| c |\n| --- |\n| 1 |\n| 2 |"}


def test_flat_markdown_stays_in_its_row(spark):
    texts_ = [json.dumps({"z": k, "a_b": {"c": 1, "b": [k, None]}, "a": {"x.y": 2}, "a.x": {"y": "last"}}) for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "id long, text string")
    got, made = rows_made(spark, lambda: trees.flat_markdown(docs, "id").collect())
    assert len(got) == 50 and made <= 50 and "Exchange" not in trees.flat_markdown(docs, "id")._jdf.queryExecution().toString()
    assert {r["text"] for r in got if r["id"] == 7} == {"## A\n- **x.y:** last\n\n## A B\n- **b[0]:** 7\n- **b[1]:** null\n- **c:** 1\n\n## Z\n- 7"}


def test_flat_markdown_hands_on_leaves_only(spark):
    deep = lambda n, k: '{"key":' * n + str(k) + "}" * n
    texts_ = [deep(400, k) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "id long, text string")
    got, size = bytes_from_python(spark, lambda: trees.flat_markdown(docs, "id").collect())
    assert {r["id"]: r["text"] for r in got} == {k: "## Key\n- **" + ".".join(["key"] * 399) + f":** {k}" for k in range(20)}
    # One path a document, not those of all the nodes above it, too.
    assert 0 < size < 2 * sum(map(len, texts_))


def test_merged_schema_reads_texts_once(spark):
    texts_ = [json.dumps({"k": k, "in": {"l": [1, None] if k % 2 else [], "o": {}}, "": {"e": 1.5}}) for k in range(300)]
    odd = [None, "", "{", "5", "[]", "{}", ' [true] ', '{"k": 1, "k": 2}', '{"k": "s", "big": %s, "huge": %s, "f": 1.0, "e": 1e3, "neg": -0}' % ("9" * 38, "9" * 39), "[" * 70 + "]" * 70, "[" * 900 + "]" * 900, '{"a\\u00e9\\n": null} tail']
    docs = spark.createDataFrame([(t,) for t in [*texts_, *odd]], "text string").repartition(3)
    got, made = rows_made(spark, lambda: {r["path"]: (r["types"], r["n"], r["share"]) for r in schemas.merged_schema(docs, "text").collect()})
    deep = {"[]" * n: ("array", 2) for n in range(2, 65)}
    want = {"k": ("int|string", 301), "in": ("object", 300), "in.l": ("array", 300), "in.l[]": ("int|null", 300), "in.o": ("object", 300), "": ("object", 300), "e": ("float", 301), "big": ("int", 1), "huge": ("float", 1), "f": ("float", 1), "neg": ("int", 1), "a\u00e9\n": ("null", 1)}
    want |= {"[]": ("array|bool|null", 4)} | deep
    n_json = len(texts_) + 8
    assert got == {p: (t, n, round(n / n_json, 6)) for p, (t, n) in want.items()}
    assert made <= len(texts_) + len(odd)


def test_impact_leaves_edges_from_unreached_nodes_behind(spark):
    tops = [(f"t{k}", f"n{k % 5}") for k in range(3000)]
    chain = [(f"n{k}", f"n{k + 1}") for k in range(12)] + [("n12", "n9"), ("n3", "n3")]
    edges = spark.createDataFrame([*tops, *chain, *[("t7", f"n{k}") for k in (3, 4, 5)]], "src string, dst string").repartition(3)
    seeds = edges.select(F.col("src").alias("node")).where("node <> 'n9'")
    got, shuffled = rows_shuffled(spark, lambda: codegraph.top_impacted(edges, seeds, candidates=8, n=4).collect())
    # Candidates are t7 with four edges, n3 with two, and the first by name of those with one.
    assert [tuple(r) for r in got] == [("n0", 12), ("n1", 11), ("t7", 11), ("n2", 10)]
    # The edges are shuffled for the degrees, for the seeds and the walk, but not in each of its rounds.
    assert shuffled <= 8 * edges.count()


def test_walks_of_many_graphs_send_nothing_through_the_driver(spark):
    told = [("s", "i", None, 0), ("i", "a", "then", 0), ("i", "b", "else", 1), ("a", "e", None, 0), ("b", "e", None, 0)]
    edges = spark.createDataFrame([(k, *one, None) for k in range(40) for one in told], "graph long, src string, dst string, label string, place int, measured double")
    kinds = [("s", "START"), ("i", "IF"), ("a", "CALL"), ("b", "CALL"), ("e", "END")]
    nodes = spark.createDataFrame([(k, *one) for k in range(40) for one in kinds], "graph long, node string, kind string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    paths, whole = flows.control_paths(nodes, edges)
    assert {(r["rank"], "".join(r["path"]), r["probability"]) for r in paths.collect()} == {(1, "siae", 0.5), (2, "sibe", 0.5)} and whole.where("NOT truncated").count() == 40
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    executions = store.executionsList()
    names = set()
    for at in range(before, executions.size()):
        steps = store.planGraph(executions.apply(at).executionId()).allNodes()
        names |= {steps.apply(k).name() for k in range(steps.size())}
    assert "SortMergeJoin" in names and "BroadcastExchange" not in names
