"""Files in and out: lines, JSON, spans, GraphML, delimited files, documents, streams that go on, plug-ins."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import plugins, sinks, sources, streaming
from tidemark.functions import flow, markup
from tidemark.operators import documents, graph, learning, logs, openapi, tables


def test_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("one\r\ntwo\nthrée", encoding="utf-8")
    (tmp_path / "y.txt").write_text("four")
    (tmp_path / "z.bin").write_text("no")
    got = sources.text_lines(spark, str(tmp_path)).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["text"]) for r in got) == [("x.log", 1, "one"), ("x.log", 2, "two"), ("x.log", 3, "thrée"), ("y.txt", 1, "four")]
    assert sources.text_lines(spark, str(tmp_path), limit=1).count() == 2
    split = sources.split_lines(spark, str(tmp_path)).orderBy("file", "line").collect()
    assert [r["text"] for r in split] == ["one", "two", "thrée", "four"]


def test_sessions_over_blocks(spark):
    text = ["junk", "", "2024-01-01 00:00:00 ERROR [a] boom"] + [f"more {k}" for k in range(7)] + ["2024-01-01 00:00:01.123 [main] INFO  b.C - fine", "java.lang.X", "my.BadException: y", "... 3 more", "tail"]
    lines = spark.createDataFrame([("f", k + 1, t) for k, t in enumerate(text)] + [("g", 1, "lost")], "file string, line long, text string")
    want = [(3, "ERROR", "a", "boom\n" + "\n".join(f"more {k}" for k in range(7)), None), (11, "INFO", "b.C", "fine\ntail", "java.lang.X\nmy.BadException: y\n... 3 more")]
    for block in (1, 2, 5, 1000):
        got = sorted(logs.sessionize(lines, block=block).collect(), key=lambda r: r["line"])
        assert [(r["line"], r["level"], r["logger"], r["message"], r["stacktrace"]) for r in got] == want
        assert sorted(map(tuple, logs.malformed(lines, block=block).collect())) == [("f", 1), ("g", 1)]


def test_delimited(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffID;Name; x\n1;a;2\n3\n", encoding="utf-8")
    rows = tables.delimited(spark, str(tmp_path / "t.csv"))
    assert rows.columns == ["ID", "Name", " x"] and [tuple(r) for r in rows.collect()] == [("1", "a", "2"), ("3", None, None)]
    assert tables.project(rows, ["name", "id"]).columns == ["Name", "ID"]
    assert tables.project(rows, ["name", "id"], [0]).columns == ["ID"] and tables.project(rows, places=[2]).columns == [" x"]
    with pytest.raises(ValueError, match="no such column"):
        tables.project(rows, ["gone"])


def test_table_leaves_out_empty_rows(spark):
    rows = spark.createDataFrame([(1, "a|b", float("nan")), (2, None, float("nan")), (3, "c\\d\ne", 2.0)], "k int, t string, x double")
    got = [r["line"] for r in tables.gfm_table(rows, "k", ["t", "x"]).orderBy("place").collect()]
    assert got == ["| t | x |", "| --- | --- |", "| a\\|b |  |", "| c\\\\d e | 2 |"]
    money = spark.createDataFrame([(1,)], "k int").select(F.expr("CAST(1.50 AS DECIMAL(5,2)) AS d"), F.expr("CAST(2 AS DECIMAL(5,2)) AS e"))
    assert tuple(money.select(tables.cell_text(money, "d"), tables.cell_text(money, "e")).first()) == ("1.5", "2")


def test_cut_bytes(spark):
    texts = [None, "", "abc", "aé日🎉z" * 30]
    for size in range(8, 20):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tables.cut_bytes(F.col("t"), size, "!").alias("c")).collect()
        for r in got:
            raw = (r["t"] or "").encode()
            assert r["c"] == (r["t"] if len(raw) <= size else raw[:size].decode(errors="ignore") + "!")


def test_spans_and_graphml(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"spans": [{"traceId": "t", "spanId": "s", "name": "n", "service": "v", "startTime": 1.5}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"traceId": "u", "spanId": "s2"}]))
    (tmp_path / "c.json").write_text("{broken")
    assert sorted((r["trace_id"], r["span_id"], r["start_s"]) for r in sources.span_files(spark, str(tmp_path)).collect()) == [("t", "s", 1.5), ("u", "s2", None)]
    (tmp_path / "g.graphml").write_text('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="name"/><graph><node id="a"><data key="d0">Ann</data></node><node id="b"/><edge source="a" target="b"/></graph></graphml>')
    nodes, edges = sources.graphml(spark, str(tmp_path))
    assert sorted((r["id"], dict(r["properties"])) for r in nodes.collect()) == [("a", {"name": "Ann"}), ("b", {})]
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("a", "b")]


def test_otlp_logs(spark):
    text = json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeLogs": [{"logRecords": [{"severityText": "WARN", "traceId": "t", "body": {"stringValue": "b"}}]}]}]})
    assert [tuple(r) for r in sources.otlp_logs(spark.createDataFrame([(text,)], "raw string"), "raw").collect()] == [("api", "WARN", "b", "t")]


def test_json_fields(spark):
    lines = ['{"level":{"name":"warn"},"attributes":{"enduser.id":"e","client.address":"1.2.3.4"},"msg":"x"}', '{"user":{"id":"7"},"message":"m"}', "[1]", "no", None, '{"source":{"ip":"9.9.9.9"}}']
    got = sources.json_log(spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, raw string"), "raw").orderBy("k").collect()
    assert [(r["k"], r["level"], r["message"]) for r in got] == [(0, "WARN", "x user=e ip=1.2.3.4"), (1, "INFO", "m user=7"), (5, "INFO", "ip=9.9.9.9")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b|c")], "k long, t string")
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(str(tmp_path / "j")).collect())) == [(1, "a"), (2, "b|c")]
    sinks.write_parquet(rows, str(tmp_path / "p"), by="k")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_markdown(rows, "k", str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["| 1 | a |", "| 2 | b\\|c |"]
    sinks.write_documents(spark.createDataFrame([("x.md", "# X\ny")], "name string, text string"), str(tmp_path / "d"))
    assert [(r["document"], r["value"]) for r in spark.read.text(str(tmp_path / "d")).collect()] == [("x.md", "# X"), ("x.md", "y")]
    told = sinks.written_with_manifest(rows, str(tmp_path / "w"), {"b": 1, "a": 2})
    assert told["rows"] == 2 and told["config"] == sinks.config_hash({"a": 2, "b": 1})


def test_streams_resume(spark, tmp_path):
    data, out, offsets = (str(tmp_path / d) for d in ("data", "out", "offsets"))
    schema = "ts timestamp, key string"

    def add(*rows):
        spark.createDataFrame([(datetime.fromisoformat(t), k) for t, k in rows], schema).coalesce(1).write.mode("append").parquet(data)

    def run():
        stream = spark.readStream.schema(schema).parquet(data)
        counts = stream.withWatermark("ts", "1 minute").groupBy(F.window("ts", "10 minutes")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "HH:mm").alias("start"), "n")
        return sorted((r["start"], r["n"]) for r in streaming.resumed(counts, out, offsets).select("start", "n").collect())

    add(("2024-01-01 10:01", "a"), ("2024-01-01 10:02", "b"), ("2024-01-01 10:15", "c"))
    assert run() == [("10:00", 2)]
    add(("2024-01-01 10:03", "late"), ("2024-01-01 10:45", "d"))  # the first window has closed by now
    assert run() == [("10:00", 2), ("10:10", 1)]
    assert run() == [("10:00", 2), ("10:10", 1)]
    once = streaming.first_of_key(spark.readStream.schema(schema).parquet(data), ["key"])
    assert once.isStreaming
    with pytest.raises(ValueError, match="no such stream"):
        streaming.source(spark, "pigeon")


class Upper:
    def can_parse(self, sample):
        return sample.startswith("U")

    def parse(self, text):
        yield from ({"word": w} for w in text.split())


def test_plugins(spark):
    rows = spark.createDataFrame([("a", "U x y"), ("b", "other"), ("c", None)], "path string, text string")
    assert sorted(map(tuple, plugins.parsed(rows, [Upper()], "path string, word string").collect())) == [("a", "U"), ("a", "x"), ("a", "y")]
    assert plugins.loaded(["json:dumps", "json:gone", "no.such:x"]) == [json.dumps]
    assert plugins.enriched(rows, [lambda d: d.withColumn("one", F.lit(1)), lambda d: d.where("path <> 'b'")]).count() == 2
    registry = plugins.Registry(all=lambda d: d)
    registry.add("some")(lambda d: d.where("path = 'a'"))
    assert registry.run(rows, ["all", "some"]).groupBy("source").count().count() == 2
    stages, took = plugins.run_stages(rows, [("one", lambda d: d.limit(1)), ("two", lambda d: d)])
    assert stages.count() == 1 and [n for n, _ in took] == ["one", "two"]
    assert [n for n, _ in plugins.run_stages(rows, [("one", lambda d: d)], lambda: True)[1]] == []
    assert plugins.encoded(rows, "text", lambda ts: [[float(len(t))] for t in ts], 2).select("vector").collect()[1][0] == [5.0]


def test_presets(tmp_path):
    for folder, names in (("one", "ab"), ("two", "bc")):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.json").write_text("{}")
    found = sources.presets([str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "none")])
    assert {k: v.split("/")[-2] for k, v in found.items()} == {"a": "one", "b": "one", "c": "two"}


def test_control_flow(spark):
    code = "def f(x):\n    for i in x:\n        if i:\n            break\n        g(i)\n    else:\n        return 1\n    raise ValueError('n')\n"
    got = flow.control_flow(spark.createDataFrame([("a.py", code), ("b.py", "def (")], "path string, text string")).collect()
    steps = {r["node"]: r["kind"] for r in got}
    edges = {(r["node"], r["dst"], r["branch"]) for r in got}
    assert steps == {0: "start", 1: "loop", 2: "if", 3: "call", 4: "return", 5: "raise", 6: "end"}
    assert edges == {(0, 1, "next"), (1, 2, "true"), (2, 3, "false"), (3, 1, "repeat"), (1, 4, "exit"), (2, 5, "break"), (4, 6, "next"), (5, 6, "next"), (6, -1, "")}


def test_rules_and_entries(spark):
    files = [("a.py", "@app.get('/x')\ndef f(x):\n    assert x > 0\n    if x:\n        raise KeyError(x)\nif __name__ == '__main__':\n    f(1)\n"), ("t.sql", "CREATE OR REPLACE TRIGGER audit BEFORE"), ("J.java", "@KafkaListener(topics = \"t\")\nvoid m() {}")]
    rows = spark.createDataFrame(files, "path string, text string")
    assert sorted((r["path"], r["symbol"], r["kind"], r["detail"]) for r in flow.business_rules(rows).collect()) == [
        ("a.py", "", "branch", "__name__ == '__main__'"), ("a.py", "f", "branch", "x"), ("a.py", "f", "raise", "KeyError(x)"), ("a.py", "f", "validation", "x > 0"), ("t.sql", "audit", "trigger", ""),
    ]
    assert sorted(map(tuple, flow.entries(rows).collect())) == [("J.java", "kafka", 1), ("a.py", "api_rest", 1), ("a.py", "main", 1)]


def test_openapi_two_and_three(spark):
    old = {
        "swagger": "2.0", "host": "h", "basePath": "/b", "definitions": {"P": {"type": "object", "discriminator": "kind"}}, "parameters": {"q": {"name": "q", "in": "query", "type": "integer"}},
        "paths": {"/p/{id}": {"post": {"parameters": [{"$ref": "#/parameters/q"}, {"name": "b", "in": "body", "schema": {"$ref": "#/definitions/P"}}], "responses": {"200": {"description": "ok", "schema": {"type": "array", "items": {"$ref": "#/definitions/P"}}}}}}},
    }
    new = openapi.upgraded(old)
    assert new["openapi"] == "3.0.3" and new["servers"] == [{"url": "https://h/b"}] and new["components"]["schemas"]["P"]["discriminator"] == {"propertyName": "kind"}
    got = openapi.operations(spark.createDataFrame([("s", json.dumps(old)), ("bad", "{"), ("none", None)], "spec string, text string")).collect()
    assert [(r["method"], r["operation_id"], list(r["parameters"]), list(r["request_refs"]), list(r["response_refs"])) for r in got] == [("post", "post_/p/{id}", ["path:id", "query:q"], ["#/components/schemas/P"], ["#/components/schemas/P"])]


def test_schemas():
    parts = [{"allOf": [{"properties": {"b": {"type": "integer"}}, "required": ["b"]}]}, {"type": "object", "description": " d ", "properties": {"a": {"type": "string", "format": "date"}}, "required": ["a"], "x": 1}]
    merged = openapi.merged_all_of(parts)
    assert merged == {"type": "object", "properties": {"a": {"type": "string", "format": "date"}, "b": {"type": "integer"}}, "required": ["a", "b"], "description": "d", "x": 1}
    assert openapi.sample_value(merged) == {"a": "2000-01-01", "b": 0} and openapi.sample_value(merged, "a") == {"b": 0}
    assert openapi.sample_value({"oneOf": [{"type": "array", "items": {"enum": ["z", "y"]}}]}) == ["y"]


def test_clusters(spark):
    rows = spark.createDataFrame([(k, [float(k % 2 * 10 + k / 100), 1.0]) for k in range(40)], "vec_id long, embedding array<double>")
    got = learning.k_means(rows, k=2).groupBy("cluster").agg(F.min(F.col("vec_id") % 2).alias("a"), F.max(F.col("vec_id") % 2).alias("b")).collect()
    assert len(got) == 2 and all(r["a"] == r["b"] for r in got)
    docs = spark.createDataFrame([(1, "the cat cat"), (2, "a dog"), (3, None)], "doc_id long, text string")
    assert [r["features"].numNonzeros() for r in learning.tf_idf(docs).orderBy("doc_id").collect()] == [1, 1, 0]


def test_sections_and_footers(spark):
    text = "---\na: b\n---\nintro\n## One\nx\n## Two\ny"
    got = documents.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()
    assert [r["text"].strip() for r in got] == ["intro", "## One\nx", "## Two\ny"]
