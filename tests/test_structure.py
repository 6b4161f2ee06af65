"""Cases that the tables lack: null and empty inputs, archives, code, and shapes of lines."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.code import call_edges, python_symbols
from tidemark.functions.nested import json_leaves
from tidemark.operators import codegraph, documents, graph, html, logs, search
from tidemark.sources.archives import archive_members, decoded


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def edges(spark, *rows):
    return spark.createDataFrame([(*r, "CALLS")[:3] for r in rows], "src string, dst string, relation string")


def test_archives(spark, tmp_path):
    inner, outer = io.BytesIO(), tmp_path / "a.zip"
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        data = b"in\xe9"
        info = tarfile.TarInfo("d/deep.log")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(outer, "w") as z:
        for name, body in (("x.log", b"\xef\xbb\xbfhello"), ("../out.log", b"no"), ("__MACOSX/x.log", b"no"), ("y.bin", b"no"), ("n.tgz", inner.getvalue()), ("empty.txt", b"")):
            z.writestr(name, body)
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 not really")
    got = archive_members(spark, str(tmp_path)).select(F.substring_index("member", "a.zip!", -1).alias("m"), decoded(F.col("content")).alias("t")).collect()
    assert {r["m"]: r["t"] for r in got} == {"x.log": "hello", "n.tgz!d/deep.log": "in\u00e9", "empty.txt": ""}


def test_python_symbols(spark):
    source = "import os\nfrom .a import b\n\nclass C:\n    def f(self):\n        return g(os.path.join('x'))\n"
    files = spark.createDataFrame([("m.py", source), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    found = python_symbols(files)
    got = {(r["path"], r["kind"], r["name"], r["owner"], r["line"]) for r in found.collect()}
    assert got == {("m.py", "import", "os", "", 1), ("m.py", "import", ".a", "", 2), ("m.py", "class", "C", "", 4), ("m.py", "function", "C.f", "C", 5), ("m.py", "call", "g", "C.f", 6), ("m.py", "call", "os.path.join", "C.f", 6), ("bad.py", "error", "", "", 0)}
    assert ("m.py::C.f", "g", "CALLS") in set(map(tuple, call_edges(found).collect()))


def test_json_leaves(spark):
    rows = [None, "", "not json", "[]", json.dumps({"a": {"b": [{"c": 1.50}, None, True]}, "e": {}, "s": "x"}), "7"]
    got = texts(spark, *rows).select("doc_id", json_leaves(F.col("text")).alias("x")).collect()
    assert [[tuple(p) for p in r["x"]] for r in sorted(got)] == [[], [], [], [], [("a.b[0].c", "1.5"), ("a.b[1]", "null"), ("a.b[2]", "true"), ("e", "{}"), ("s", "x")], [("value", "7")]]


def test_lines(spark):
    docs = texts(spark, None, "", "Name: x\nAge: 3\n\nCity: y\n- item\n1.2 part\nALL CAPS\nplain")
    assert {r["kind"]: r["n"] for r in documents.line_kinds(docs).collect()} == {"blank": 3, "pair": 3, "bullet": 1, "numbered": 1, "heading": 1, "text": 1}
    assert sorted(map(tuple, documents.pair_runs(docs).collect())) == [(2, 0, 2), (2, 3, 1)]
    footers = texts(spark, "a\n Confidential \nb", None).select(documents.without_footers(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in footers] == ["a\nb", None]
    parts = documents.sections(texts(spark, "---\nk: v\n---\nhead\n## A\nx\n## B\n" + "y" * 50, None, "  "), clip=20).collect()
    assert sorted(map(tuple, parts)) == [(0, 0, "head\n"), (0, 1, "## A\nx\n"), (0, 2, "## B\n" + "y" * 15)]
    assert {(r["doc_id"], r["n"]) for r in documents.distinct_contents(texts(spark, "a", None, "", "a")).collect()} == {(0, 2), (1, 2)}
    assert documents.distinct_contents(texts(spark).where("false")).collect() == []
    times = spark.createDataFrame([(0,), (3_723_004,)], "ms long").select(documents.clock(F.col("ms"))).collect()
    assert [r[0] for r in times] == ["0:00:00.000", "1:02:03.004"]


def test_reach_counts(spark):
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(70)] + [("n70", "n60"), ("n5", "x"), ("x", "n5"), ("y", "y")]
    seeds = [f"n{k}" for k in range(71)] + ["y", "absent"]
    got = graph.reach_counts(edges(spark, *pairs), seeds)
    want = {}
    for s in seeds:
        found, front = {s}, [s]
        while front:
            front = [b for a, b in pairs if a in front and b not in found]
            found |= set(front)
        want[s] = len(found) - 1
    assert got == want and graph.reach_counts(edges(spark, *pairs), []) == {}


def test_hints_and_tags(spark):
    asked = {"who calls `a.b` or `c`": "c", "impact for `x y`": "x y", "impact FOR m :: n now": "m :: n", "called by 'q'": "q", "called by Svc.run today": "Svc.run", "what is affected downstream of the Parser": "Parser", "show me the calls": None, "": None}
    got = spark.createDataFrame([(q,) for q in asked], "q string").select("q", codegraph.target_hint(F.col("q")).alias("h")).collect()
    assert {r["q"]: r["h"] for r in got} == asked
    rows = spark.createDataFrame([(1, "ERROR", "plain", "java.net: connection refused"), (2, "INFO", "timed out", None)], "line long, level string, message string, stacktrace string")
    assert {r["line"]: r["tags"] for r in logs.tagged(rows).collect()} == {1: "network", 2: "timeout"}


def test_cross_repo_imports(spark):
    nodes = [("aa::file:app/main.py", "aa", "python"), ("aa::file:J.java", "aa", "java"), ("aa::x", "aa", None), ("aa::external::com.other.util", None, None), ("bb::file:com/other/util.py", "bb", "python")]
    nodes += [("bb::file:com/other/twice.py", "bb", None), ("bb::file:com/other/twice/__init__.py", "bb", None), ("bb::class:p/T.java::Thing", "bb", "java"), ("bb::class:a::Two", "bb", "java"), ("bb::class:b::Two", "bb", "java"), ("bb::file:com/other/K.kt", "bb", "kotlin"), ("lone", " ", None)]
    main, java = "aa::file:app/main.py", "aa::file:J.java"
    edges = [(main, "aa::external::com.other.util", "IMPORTS", 0.8), (main, "external::com.other.twice", "IMPORTS", 0.8), (java, "aa::external::com.other.deep.Thing", "IMPORTS", 0.99), (java, "external::com.other.Two", "IMPORTS", None)]
    edges += [(java, "external::com.other.K$Inner", "IMPORTS", None), (main, "external::com.otherwise", "IMPORTS", 0.8), (main, "external::com.other.*", "IMPORTS", 0.8), (main, "external::relative::com.other.util", "IMPORTS", 0.8), (main, "external::own.util", "IMPORTS", 0.8), (main, "external::com.gone.util", "IMPORTS", 0.8), (main, "bb::file:com/other/util.py", "CALLS", 0.8), ("lone", "external::com.other.util", "IMPORTS", 0.8)]
    hints = [("com.other", "bb"), ("own", "aa"), ("com.gone", "cc"), (" ", "bb"), ("com", "aa")]
    got = codegraph.cross_repo_imports(spark.createDataFrame(nodes, "id string, repo string, language string"), spark.createDataFrame(edges, "src string, dst string, relation string, confidence double"), spark.createDataFrame(hints, "prefix string, repo string")).collect()
    assert sorted((r["src"], r["dst"], r["relation"], r["confidence"], r["hint_prefix"]) for r in got) == [
        (java, "bb::class:p/T.java::Thing", "CROSS_REPO_IMPORT", 0.95, "com.other"), (java, "bb::file:com/other/K.kt", "CROSS_REPO_IMPORT", 0.8, "com.other"), (main, "bb::file:com/other/util.py", "CROSS_REPO_IMPORT", 0.85, "com.other"),
    ]


def test_same_site(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x", '<a href="/y#f">1</a><a href="https://m.a.example/z">2</a><a href="http://a.example/">3</a><a href="https://ba.example/">4</a><a href="q">5</a>'), (2, None, None)], "page_id long, url string, html string")
    got = {r["link"]: r["inside"] for r in html.links(pages).collect()}
    assert got == {"https://a.example/y": True, "https://m.a.example/z": True, "http://a.example/": False, "https://ba.example/": False, "https://a.example/q": True}


@pytest.mark.parametrize(("start", "depth", "cap", "want"), [("b", 1, 9, {"b", "a", "c"}), ("b", 0, 9, {"b", "a", "c", "d"}), ("b", 0, 2, {"b", "a"}), ("zz", 3, 9, set())])
def test_neighbourhood(spark, start, depth, cap, want):
    assert {r["node"] for r in graph.neighbourhood(edges(spark, ("a", "b"), ("b", "c"), ("c", "d")), start, depth, cap).collect()} == want


def test_graph_sets(spark):
    links = edges(spark, ("m", "n"), ("n", "z"), ("z", "m"), ("k", "z"))
    seeds = spark.createDataFrame([("z",), ("unknown",)], "node string")
    assert {(r["seed"], r["node"]) for r in graph.ancestors(links, seeds).collect()} == {("z", "n"), ("z", "m"), ("z", "k")}
    assert {r["node"] for r in graph.impact(links, seeds).collect()} == {"z", "m", "n", "unknown"}
    two = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "w"), ("x", "w"))
    labels = {r["node"]: r["community"] for r in graph.communities(two).collect()}
    assert len({labels[n] for n in "abc"}) == 1 and len({labels[n] for n in "xyw"}) == 1 and labels["a"] != labels["x"]
    assert graph.communities(two.where("false")).collect() == []
    paths = spark.createDataFrame([("g", "a/b/c"), ("g", "a/b/d/e"), ("h", "q"), ("i", "x/y"), ("i", "z")], "g string, p string")
    assert {r["g"]: r["prefix"] for r in graph.common_prefix(paths, "g", "p").collect()} == {"g": "a/b", "h": "q", "i": ""}
    ends = spark.createDataFrame([("A", ["X"], []), ("B", [], ["X", "X"]), ("C", ["X"], ["Y"]), ("D", None, None)], "endpoint string, responses array<string>, requests array<string>")
    assert sorted(map(tuple, graph.shared_references(ends).collect())) == [("A", "B"), ("C", "B")]


def test_chunks_bound_their_texts(spark):
    rows = [("f", k, None, "ERROR" if k < 3 else "INFO", None, "same" if k < 3 else f"m{k:03d}") for k in range(40)]
    records = spark.createDataFrame(rows, "file string, line long, ts timestamp, level string, logger string, message string")
    got = {r["kind"]: r for r in logs.chunks(records, service_size=5, timeline_size=10).collect()}
    assert (got["incident"]["n"], got["service"]["text"], got["timeline"]["n"]) == (3, "same\nsame\nsame\nm003\nm004", 10)


def test_hash_vector(spark):
    vector = texts(spark, "", None).select(search.hash_vector(F.col("text")).alias("v")).collect()
    assert len(vector[0]["v"]) == 64 and vector[0]["v"][0] == (0xE3 - 128) / 128 and vector[0]["v"][32] == vector[0]["v"][0]


def test_nearest_of_any_label(spark):
    rows = [(k, k % 2, [1.0 - k / 100, k / 100]) for k in range(40)]
    data = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    asked = data.where("vec_id = 39")
    assert [r["vec_id"] for r in search.nearest(data, asked, k=3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r["vec_id"] for r in search.nearest(data, asked, k=3, subset="label").orderBy("rank").collect()] == [1, 3, 5]


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(99)], "src long, dst long").coalesce(1)
    assert [r["depth"] for r in graph.impact(edges, spark.createDataFrame([(0,)], "node long")).orderBy("node").collect()] == list(range(100))
    assert graph.descendants(edges, spark.createDataFrame([(0,)], "node long"), depth=3).count() == 3
