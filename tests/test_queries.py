"""Every query that has SQL gives the rows of its SQL; null and empty cases of core operators."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import text as fn
from tidemark.operators import documents, graph, logs
from tidemark.operators.components import connected_components
from tidemark.plans import registry as plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    expected = sorted((tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()), key=str)
    assert len(rows) == len(expected)
    assert all(same(x, y) for a, b in zip(rows, expected, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "incident_id"
    assert set(plans.SQL) < set(plans.QUERIES) <= set(__spark_entry__.queries())


def test_chunks_are_greedy(spark):
    texts = [None, "", "a\nbb\nccc", "x" * 30, "a\n" * 20, "one\n\ntwo"]
    got = documents.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=6).collect()
    for d, t in enumerate(texts):
        done, open_ = [], None
        for line in (t or "").split("\n"):
            if open_ is None:
                open_ = line
            elif len(open_) + 1 + len(line) <= 6:
                open_ += "\n" + line
            else:
                done.append(open_)
                open_ = line
        assert [r["text"] for r in sorted(got, key=lambda r: r["chunk"]) if r["doc_id"] == d] == [*done, open_]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 1), (20, 19), (19, 18), (18, 17), (17, 3)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**dict.fromkeys([1, 2, 3, 17, 18, 19, 20], 1), 8: 8, 9: 8, 5: 5}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_sessions(spark):
    text = ["junk", "2024-01-01 00:00:00 ERROR [a] boom", "\tat x.Y(Z.java:1)", "Caused by: q", "more", "2024-01-01 00:00:01 INFO [b] fine"]
    lines = spark.createDataFrame([("f", k + 1, t) for k, t in enumerate(text)], "file string, line long, text string")
    got = sorted(logs.sessionize(lines).collect(), key=lambda r: r["line"])
    assert [(r["line"], r["level"], r["message"], r["stacktrace"]) for r in got] == [(2, "ERROR", "boom\nmore", "\tat x.Y(Z.java:1)\nCaused by: q"), (6, "INFO", "fine", None)]


def test_masks_and_entropy(spark):
    row = spark.createDataFrame([("u 550e8400-e29b-41d4-a716-44665544abcd at /var/log/x from 10.0.0.1 a.b@c.de 42",)], "t string")
    assert row.select(fn.normalize(F.col("t"))).first()[0] == "u <UUID> at <PATH> from <NUM>.<NUM>.<NUM>.<NUM> <EMAIL> <NUM>"
    values = spark.createDataFrame([("",), (None,), ("aaaa",), ("ab",)], "t string").select(fn.char_entropy(F.col("t"))).collect()
    assert [round(r[0], 6) for r in values] == [0.0, 0.0, 0.0, 1.0]


def test_graph_cases(spark):
    edges = spark.createDataFrame([("m", "n", "CALLS"), ("n", "z", None), ("m", "q", "CONTAINS")], "src string, dst string, relation string")
    assert sorted(map(tuple, graph.simple(edges).collect())) == [("m", "n"), ("n", "z")]
    seeds = spark.createDataFrame([("m",)], "node string")
    assert {r["node"] for r in graph.descendants(graph.simple(edges), seeds).collect()} == {"n", "z"}


def test_incidents_by_whole_message(spark):
    head = "x" * 80
    rows = [(k, "ERROR", f"s{k % 2}", f"{head} {end} {k}", f"Traceback\n {k // 2 * 2}" if k < 4 else None) for k, end in enumerate(["pool timeout", "pool timeout", "disk full", "disk full", "once"])]
    rows += [(9, "INFO", "s9", f"{head} pool timeout 9", None)]
    data = spark.createDataFrame(rows, "line long, level string, logger string, message string, stacktrace string").withColumn("file", F.lit("f"))
    got = sorted(logs.incidents(data).collect(), key=lambda r: r["first_line"])
    assert [(r["n"], r["title"], r["cause"], r["first_line"], r["last_line"], r["services"]) for r in got] == [(2, head, "pool exhaustion", 0, 1, "s0,s1"), (2, head, "dependency", 2, 3, "s0,s1")]
    assert [list(r["messages"]) for r in got] == [[rows[0][3], rows[1][3]], [rows[2][3], rows[3][3]]]
    assert [list(r["stacktraces"]) for r in got] == [["Traceback\n 0"], ["Traceback\n 2"]]
    assert len({r["incident_id"] for r in got}) == 2


def test_incidents_of_the_events(spark):
    got = __spark_entry__.queries()["log_incidents_whole"](spark, FOLDER).collect()
    assert len(got) > 1 and {r["cause"] for r in got} == {"pool exhaustion"}
