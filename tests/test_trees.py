"""JSON and XML documents as nodes and as Markdown, and API descriptions that are odd."""

import json
import random
import re

from pyspark.sql import functions as F

from tidemark.functions.nested import json_leaves
from tidemark.operators import openapi, trees

JSON = [
    None, "", "{broken", "[]", "{}", "5", '"a\\nb"', "null", "true", "[1, [2, {\"a\": 1}], \"x\"]", '{"a":[1,{"b":2}]}', '{"orderKey":1,"_":2,"a-b_c":{"x":[],"y":{}}}',
    '[{"k":1,"v":"a|b"},{"v":[1,"é"],"k":null}]', '{"t":[{}, {}], "z": 1}', '{"t":[{"k": {"deep": 1}}], "u": [[{"k":1}]], "w": [{"a":1},{"b":2}]}', '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}}}', '{"a|b":"c|d\\ne"}', "[true, null, 1.50, 1e3]",
]


def plain_json(text):
    """The rules of the format, by hand for one document."""
    try:
        top = json.loads(text or "")
    except ValueError:
        return None

    def shown(v):
        return "" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)

    cell = lambda s: s.replace("|", "\\|").replace("\n", " ")

    def walk(v, depth):
        if isinstance(v, dict):
            return [line for k, x in v.items() for line in member(k, x, depth)]
        if v and all(isinstance(x, dict) and set(x) == set(v[0]) for x in v):
            if not v[0]:
                return []
            rows = [[cell(trees.label(k)) for k in v[0]], ["---"] * len(v[0]), *([cell(shown(x[k])) for k in v[0]] for x in v)]
            return ["", *("| " + " | ".join(r) + " |" for r in rows), ""]
        return [line for x in v for line in (["", *walk(x, depth)] if isinstance(x, dict) else [f"- {shown(x)}"])] + [""]

    def member(k, v, depth):
        if isinstance(v, (dict, list)):
            return ["", "#" * min(6, depth) + " " + trees.label(k), *walk(v, depth + 1)]
        return [f"- **{trees.label(k)}:** {shown(v)}"]

    lines = walk(top, 2) if isinstance(top, (dict, list)) else [f"- **Value:** {shown(top)}"]
    out = "\n".join(lines)
    while "\n\n\n" in out:
        out = out.replace("\n\n\n", "\n\n")
    return out.strip()


def odd_value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 4 else 3)
    if kind == 0:
        return rng.choice([None, True, 3, -1.5])
    if kind < 4:
        return rng.choice(["x", "a|b", "", "two words"])
    if kind == 4:
        names = rng.sample(["k", "vV", "w_w"], rng.randint(0, 2))
        return [{k: odd_value(rng, depth + 2) for k in names} for _ in range(rng.randint(0, 3))]
    if kind == 5:
        return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: odd_value(rng, depth + 1) for k in rng.sample(["a", "bC", "d_e", "f-g"], rng.randint(0, 3))}


def test_json_markdown(spark):
    rng = random.Random(3)
    texts = [*JSON, *(json.dumps(odd_value(rng)) for _ in range(200)), json.dumps(list(range(30_000))), "[" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    got = {r["id"]: r["text"] for r in trees.json_markdown(docs, "id").collect()}
    assert got == {k: plain_json(t) if t != "[" * 50_000 else None for k, t in enumerate(texts)}
    assert got[JSON.index('{"orderKey":1,"_":2,"a-b_c":{"x":[],"y":{}}}')].startswith("- **Order Key:** 1\n- **_:** 2\n\n## A B C\n\n### X\n\n### Y")
    assert trees.json_markdown(docs.limit(0), "id").collect() == []


def test_contents(spark):
    docs = spark.createDataFrame([(1, '{"oneTwo":{"a":1},"b":[1],"c":2}'), (2, "[]")], "id long, text string")
    got = {r["id"]: r["text"] for r in trees.json_markdown(docs, "id", contents=True).collect()}
    assert got == {1: "## Table of contents\n\n- [One Two](#one-two)\n- [B](#b)\n\n## One Two\n- **A:** 1\n\n## B\n- 1\n\n- **C:** 2", 2: ""}


def test_xml_markdown(spark):
    texts = [
        None, "<a", "<a/>", '<a-b x="1" w:y="2" xmlns:w="u"> hi <c/>tail</a-b>', "<a><b>1</b><b>2</b></a>", "<a><r><k>x<b>y</b></k></r><r><k><b>p</b>q|</k></r></a>",
        "<a><r><k>1</k></r><r><j>1</j></r></a>", "<n:a xmlns:n='u'><n:r><n:k>1</n:k><n:k>2</n:k></n:r><n:r><n:k/><n:k>4</n:k></n:r></n:a>",
    ]
    got = {r["id"]: r["text"] for r in trees.xml_markdown(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()}
    assert got == {
        0: None, 1: None, 2: "## A", 3: "## A B\n- **x:** 1\n- **y:** 2\n\nhi\n\n### C", 4: "## A\n\n### B\n\n1\n\n### B\n\n2", 5: "## A\n\n| k |\n| --- |\n| x |\n| pq\\| |",
        6: "## A\n\n### R\n\n#### K\n\n1\n\n### R\n\n#### J\n\n1", 7: "## A\n\n| k |\n| --- |\n| 2 |\n| 4 |",
    }


def test_flat_markdown_and_leaves(spark):
    docs = spark.createDataFrame(list(enumerate(JSON)), "id long, text string")
    got = {r["id"]: r["text"] for r in trees.flat_markdown(docs, "id").collect()}
    assert [got[k] for k in range(9)] == [None, None, None, "", "", "## Value\n- 5", "## Value\n- a\nb", "## Value\n- null", "## Value\n- true"]
    assert got[10] == "## A 0\n- 1\n\n## A 1\n- **b:** 2" and got[11] == "## \n- 2\n\n## A B C\n- **x:** []\n- **y:** {}\n\n## Order Key\n- 1".replace("## \n", "## _\n")
    rows = {(r["id"], r["path"]): r["value"] for r in trees.leaves(docs, "id").collect()}
    assert rows[12, "[1].v[1]"] == "é" and rows[17, "[2]"] == "1.5" and (3, "value") not in rows
    paths = {r["id"]: [p["path"] for p in r["l"]] for r in docs.select("id", json_leaves(F.col("text")).alias("l")).collect()}
    assert paths[5] == ["value"] and paths[3] == paths[4] == [] and paths[11] == ["orderKey", "_", "a-b_c.x", "a-b_c.y"]


def plain_flat(text):
    """The flat form, by hand for one document."""
    try:
        top = json.loads(text or "")
    except ValueError:
        return None
    last = {}

    def walk(v, path, deep):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else []:
            walk(x, f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}" if path else k, True)
        if not isinstance(v, (dict, list)) or not v and deep:
            last[path or "value"] = v if isinstance(v, str) else json.dumps(v) if v is None or isinstance(v, (bool, dict, list)) else str(v)

    walk(top, "", False)
    groups = {}
    for path in sorted(last, key=lambda p: (p.partition(".")[0], p.partition(".")[2], p)):
        first, _, rest = path.partition(".")
        groups.setdefault(first, []).append(f"- **{rest}:** {last[path]}" if rest else f"- {last[path]}")
    words = lambda n: " ".join(re.sub(r"\[(\d+)\]", r" \1 ", n).replace("_", " ").split())
    out = "\n\n".join("\n".join(["## " + (trees.label(words(n)) if words(n) else n), *lines]) for n, lines in groups.items())
    return re.sub(r"\n{3,}", "\n\n", out)


def test_flat_markdown_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(trees, "BATCH_DOCS", 7)
    rng = random.Random(9)
    odd = ['{"a.":1,"a":2,"a.b":3,"a-b":4}', '{"":1,"value":2}', '{"":{"":3}}', '{".":1,"..":2}', '{"a":{"b":1},"a.b":2}', '{"a.b":2,"a":{"b":1}}', '{"a":[1],"a[0]":2}', '{"a":"\\n\\n\\n\\nx","_":{"_":1}}', '{"k":1,"k":{"é":"日"}}', '[[],{},[[]]]', "1e999", "12345678901234567890.5"]
    texts = ["{", *JSON, *odd, *(json.dumps(odd_value(rng)) for _ in range(200)), "[" * 50_000, "{"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    want = {k: plain_flat(t) if t != "[" * 50_000 else None for k, t in enumerate(texts)}
    assert {r["id"]: r["text"] for r in trees.flat_markdown(docs, "id").collect()} == want
    assert trees.flat_markdown(docs.limit(0), "id").collect() == []


def test_odd_api_documents(spark):
    old = {"swagger": "2.0", "paths": {"/p": {"post": {"security": 5, "parameters": [{"in": "formData", "type": "string"}, {"in": "formData", "name": "f"}, 7], "responses": 3}, "get": 4}, "/q": 9}, "security": 5}
    new = {"openapi": "3.0.0", "security": [7, {"k": []}], "paths": {"/n": {"put": {"requestBody": {"content": {"a/b": {"schema": {"allOf": [{"required": 5, "properties": 4}, 3, {"allOf": [{"type": "string", "required": ["z", 1]}]}]}}}}, "tags": "t"}}}}
    rows = [("a", json.dumps(old)), ("b", json.dumps(new)), ("c", "[]"), ("d", "5"), ("e", '{"paths": 3}'), ("f", '{"swagger": "2.0", "consumes": 5, "produces": {}, "schemes": 4, "host": 1, "paths": {"/x/{id}": {"get": {"produces": 7, "consumes": 3, "parameters": [{"in": "body"}], "responses": {"200": {"schema": 1}}}}}}')]
    got = {(r["spec"], r["path"], r["method"]): r for r in openapi.operations(spark.createDataFrame(rows, "spec string, text string")).collect()}
    assert set(got) == {("a", "/p", "post"), ("b", "/n", "put"), ("f", "/x/{id}", "get")}
    assert list(got["b", "/n", "put"]["security"]) == ["k"] and got["b", "/n", "put"]["sample"] == '"string"'
    assert json.loads(got["a", "/p", "post"]["sample"]) == {"f": {}}


def test_schemas_by_rule():
    merged = openapi.merged_all_of([{"type": "integer", "x": 1}, {"allOf": [{"description": "in"}]}, {"x": 2, "y": 3, "description": " out "}])
    assert merged == {"type": "object", "x": 1, "y": 3, "description": "in\nout"}
    assert openapi.sample_value({"anyOf": [{"const": None}]}) is None and openapi.sample_value({"enum": [2, "a", 1.5, None]}) is None
    assert openapi.sample_value({"type": ["a"]}) == {} and openapi.sample_value({"type": "array"}) == [] and openapi.sample_value({"type": "string", "format": "date-time"}) == "2000-01-01T00:00:00Z"
