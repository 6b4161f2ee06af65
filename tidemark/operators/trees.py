"""JSON and XML documents as nodes, and Markdown put together from the nodes.

A document becomes an array of nodes in the order of its text, each with its depth, its name and where its subtree
ends.  What a node contributes to a document is a rule over its fields; nodes below one that is shown whole by its top (a table,
a list inside a list) are left out; the lines are joined in order inside the document's row, so that nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from operator import itemgetter
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: node and last: the interval of the subtree; depth: nodes above; level: named ones of them; inside: kind of the parent; shown: the value as text,
#: a container's JSON where a cell or bullet may hold it; flat: a plain value as JSON writes it, texts without quotes; columns and cells: of lists and elements that are tables.
NODES = "node long, last long, depth int, level int, kind string, inside string, name string, title string, path string, shown string, flat string, attributes array<string>, columns array<string>, cells array<array<string>>"
BROKEN = "broken"


def _spaced(name: str) -> str:
    return re.sub("[_-]", " ", name)


@lru_cache(1 << 12)
def label(name: str) -> str:
    """A member's name as words with capitals: order_key, order-key and orderKey are all Order Key."""
    return re.sub("(?<=[a-z])(?=[A-Z])", " ", _spaced(name)).strip().title() or name


@lru_cache(1 << 12)
def _head(first: str) -> str:
    """The first segment of a leaf's path as words, numbers of elements too."""
    spaced = " ".join(re.sub(r"\[(\d+)\]", r" \1 ", first).replace("_", " ").split())
    return label(spaced) if spaced else first


def _kind(value: object) -> str:
    return "object" if isinstance(value, dict) else "list" if isinstance(value, list) else "value"


def _cell(value: object) -> str:
    return "" if value is None else json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)


def _uniform(value: object) -> bool:
    """Whether a value is a list of objects with equal names."""
    return isinstance(value, list) and len({frozenset(v) if isinstance(v, dict) else None for v in value}) == 1 and isinstance(value[0], dict)


def _json_rows(text: str, whole: bool = True) -> Iterator[dict]:
    """The nodes of a document; without ``whole``, those below a table or a list inside a list are left out."""
    waiting = [(json.loads(text), None, None, "", 0, 0)]
    n = 0
    while waiting:
        value, name, inside, path, depth, level = waiting.pop()
        kind = _kind(value)
        row = {"node": n, "depth": depth, "level": level, "kind": kind, "inside": inside, "name": name, "title": None if name is None else label(name), "path": path}
        if kind == "value" or inside == "list":
            row["shown"] = _cell(value)
        if kind == "value":
            row["flat"] = value if isinstance(value, str) else json.dumps(value) if value is None or isinstance(value, bool) else str(value)
        table = _uniform(value)
        if table:
            row["columns"] = [label(k) for k in value[0]]
            row["cells"] = [[_cell(v[k]) for k in value[0]] for v in value]
        yield row
        n += 1
        if not whole and (table or kind == inside == "list"):
            continue
        below = level + (name is not None)
        if kind == "object":
            waiting += [(v, k, kind, f"{path}.{k}" if path else k, depth + 1, below) for k, v in reversed(value.items())]
        elif kind == "list":
            waiting += [(value[k], None, kind, f"{path}[{k}]", depth + 1, below) for k in reversed(range(len(value)))]


def _json_leaves(text: str) -> Iterator[tuple[int, str, str]]:
    """The number of the node, path and value of each leaf of a document: plain values, and empty containers below the top."""
    waiting, n = [("", json.loads(text))], 0
    while waiting:
        path, value = waiting.pop()
        kind = type(value)
        if kind is dict and value:
            waiting += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]
        elif kind is list and value:
            waiting += [(f"{path}[{k}]", value[k]) for k in range(len(value) - 1, -1, -1)]
        elif n or kind is not dict and kind is not list:
            # Numbers as Python shows them; null, truth values and empty containers as JSON writes them.
            yield n, path or "value", value if kind is str else str(value) if kind is int or kind is float else json.dumps(value)
        n += 1


def _last_leaves(text: str) -> Iterable[tuple[str, str]]:
    """Path and value of the leaves of a document; of equal paths the last counts."""
    return {path: value for _, path, value in _json_leaves(text)}.items()


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _own_text(element: ElementTree.Element) -> str:
    return (element.text or "").strip()


def _xml_rows(text: str, whole: bool = True) -> Iterator[dict]:
    """The nodes of a document; without ``whole``, those below a table are left out."""
    waiting = [(ElementTree.fromstring(text), None, "", 0)]
    n = 0
    while waiting:
        element, inside, path, level = waiting.pop()
        name = _local(element.tag)
        path = f"{path}/{name}"
        row = {"node": n, "depth": level, "level": level, "kind": "element", "inside": inside, "name": name, "title": _spaced(name).title(), "path": path, "shown": _own_text(element)}
        row["attributes"] = [f"- **{_local(k)}:** {v}" for k, v in element.items()]
        # Two siblings or more of one name, whose children have the same names: a table of their texts.
        shapes = {(_local(c.tag), *sorted(_local(s.tag) for s in c)) for c in element}
        if len(element) > 1 and len(shapes) == 1 and len(element[0]):
            row["columns"] = sorted({_local(s.tag) for s in element[0]})
            texts = [{_local(s.tag): _own_text(s) or "".join(s.itertext()).strip() for s in c} for c in element]
            row["cells"] = [[t[k] for k in row["columns"]] for t in texts]
        yield row
        n += 1
        if whole or "columns" not in row:
            waiting += [(c, "element", path, level + 1) for c in reversed(element)]


def _close(rows: list[dict]) -> None:
    """Sets where each row's subtree ends: before the next row that is no deeper."""
    waiting: list[dict] = []
    for row in rows:
        while waiting and waiting[-1]["depth"] >= row["depth"]:
            waiting.pop()["last"] = row["node"] - 1
        waiting.append(row)
    for row in waiting:
        row["last"] = rows[-1]["node"]


#: Nodes and documents that are handed to Spark at once.
BATCH_NODES, BATCH_DOCS = 20_000, 1024


def _columns(rows: list[tuple], fields: list[pa.Field]) -> list[pa.Array]:
    return [pa.array(list(map(itemgetter(k), rows)), f.type) for k, f in enumerate(fields)]


def _split_columns(rows: list[tuple], fields: list[pa.Field]) -> list[pa.Array]:
    """Of rows of path and value: first segments, what follows their dots (null without one), headings and values. Each path is split once."""
    paths, values = _columns(rows, [fields[0], fields[3]])
    places = paths.dictionary_encode()
    split = [path.partition(".") for path in places.dictionary.to_pylist()]
    told = _columns([(first, rest if dot else None, _head(first)) for first, dot, rest in split], fields[:3])
    return [*(column.take(places.indices) for column in told), values]


def _parsed(docs: DataFrame, key: str, text: str, parse: Callable[[str], Iterable], one: T.StructType, columns: Callable[[list, list[pa.Field]], list[pa.Array]] = _columns) -> DataFrame:
    """(key, nodes): what ``parse`` gives for each text, by ``columns`` as an array of ``one``; null for a text that it refuses."""
    kind = T.StructType([docs.schema[key], T.StructField("nodes", T.ArrayType(one))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        of_list = schema.field(1).type
        of_node = list(of_list.value_type)

        def told(keys: pa.Array, starts: list[int | None], rows: list[tuple]) -> pa.RecordBatch:
            nodes = pa.StructArray.from_arrays(columns(rows, of_node), fields=of_node)
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array([*starts, len(rows)], pa.int32()), nodes, type=of_list)], schema=schema)

        for batch in batches:
            start, starts, out = 0, [], []
            for at, value in enumerate(batch.column(1).to_pylist(), 1):
                try:
                    rows = list(parse(value or ""))
                    starts.append(len(out))
                    out += rows
                except (ValueError, RecursionError, ElementTree.ParseError):
                    starts.append(None)
                if len(out) > BATCH_NODES or len(starts) >= BATCH_DOCS or at == batch.num_rows:
                    yield told(batch.column(0).slice(start, at - start), starts, out)
                    start, starts, out = at, [], []

    return docs.select(key, text).mapInArrow(read, kind)


def _nodes(docs: DataFrame, key: str, text: str, parse: Callable[[str], Iterator[dict]], fields: str = "") -> DataFrame:
    """(key, nodes): the nodes of each document as an array of ``NODES``, or of those of the fields that are named."""
    every = docs.sparkSession.createDataFrame([], NODES).schema
    one = T.StructType([f for f in every if not fields or f.name in fields.split()])

    def closed(value: str) -> list[dict]:
        try:
            rows = list(parse(value))
            _close(rows)
        except (ValueError, RecursionError, ElementTree.ParseError):
            rows = [{"node": 0, "last": 0, "kind": BROKEN}]
        return rows

    return _parsed(docs, key, text, closed, one, lambda rows, fields: [pa.array([r.get(f.name) for r in rows], f.type) for f in fields])


def _rows(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.select(key, F.inline("nodes"))


def json_nodes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The key and ``NODES`` of each value of JSON documents, members in their order; a text that isn't JSON is one row of kind ``broken``."""
    return _rows(_nodes(docs, key, text, _json_rows), key)


def xml_nodes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The key and ``NODES`` of each element of XML documents, names without their namespaces."""
    return _rows(_nodes(docs, key, text, _xml_rows), key)


def _broken() -> Column:
    return F.col("nodes")[0]["kind"] == BROKEN


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _heading(n: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(n["level"] + 2, F.lit(6))), F.lit(" "), n["title"])


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _table(n: Column, header: Column, cell: Callable[[Column], Column]) -> Column:
    """Lines of a table between blank ones, none for a table without columns."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    lines = F.concat(F.array(F.lit(""), row(header), row(F.transform(n["columns"], lambda c: F.lit("---")))), F.transform(n["cells"], lambda r: row(F.transform(r, cell))), F.array(F.lit("")))
    return F.when(F.size(n["columns"]) > 0, lines).otherwise(_no_lines())


def _assembled(nodes: DataFrame, key: str, lines: Callable[[Column], Column], closed: Callable[[Column], Column], contents: bool) -> DataFrame:
    """(key, text): lines of the nodes in order, and a blank one behind the subtree of a node that is ``closed``; a single blank line at most."""
    own = F.transform("nodes", lambda n: F.struct((2 * n["node"]).alias("place"), lines(n).alias("lines")))
    ends = F.transform(F.filter("nodes", closed), lambda n: F.struct((2 * n["last"] + 1).alias("place"), F.array(F.lit("")).alias("lines")))
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.concat(own, ends)), lambda p: p["lines"])), "\n")
    plain = F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")
    if contents:
        slug = lambda n: F.regexp_replace(F.regexp_replace(F.lower(F.trim(n["title"])), r"(?U)[^\w\s-]", ""), r"(?U)[\s_]+", "-")
        item = lambda n: F.concat(F.lit("- ["), n["title"], F.lit("](#"), F.coalesce(F.nullif(slug(n), F.lit("")), F.lit("section")), F.lit(")"))
        heads = F.filter("nodes", lambda n: F.coalesce(F.exists(lines(n), lambda c: c == _heading(n)), F.lit(False)))
        listed = F.array_join(F.transform(heads, item), "\n")
        plain = F.concat(F.when(listed != "", F.concat(F.lit("## Table of contents\n\n"), listed, F.lit("\n\n"))).otherwise(""), plain)
    return nodes.select(key, F.when(~_broken(), plain).alias("text"))


def json_markdown(docs: DataFrame, key: str, text: str = "text", contents: bool = False) -> DataFrame:
    """(key, text): objects and lists under headings, lists of objects with equal names as tables, other values as bullets.

    A text that isn't JSON, null included, gives null.
    """
    nodes = _nodes(docs, key, text, lambda t: _json_rows(t, whole=False), "node last level kind inside title shown columns cells")
    table = lambda n: n["columns"].isNotNull()
    bullet = lambda n: F.coalesce((n["inside"] == "list") & (n["kind"] != "object"), F.lit(False))
    head = lambda n: F.when(n["title"].isNotNull(), F.array(F.lit(""), _heading(n))).otherwise(_no_lines())
    own = lambda n: (
        F.when(n["kind"] == BROKEN, _no_lines())
        .when(bullet(n), F.array(F.concat(F.lit("- "), n["shown"])))
        .when(n["kind"] == "value", F.array(F.concat(F.lit("- **"), F.coalesce(n["title"], F.lit("Value")), F.lit(":** "), n["shown"])))
        .when(table(n), F.concat(head(n), _table(n, F.transform(n["columns"], _escaped), _escaped)))
        .when(n["inside"] == "list", F.array(F.lit("")))
        .otherwise(head(n))
    )
    return _assembled(nodes, key, own, lambda n: (n["kind"] == "list") & ~table(n) & ~bullet(n), contents)


def xml_markdown(docs: DataFrame, key: str, text: str = "text", contents: bool = False) -> DataFrame:
    """(key, text): elements under headings with their attributes and own text, alike siblings as a table. Broken texts give null."""
    nodes = _nodes(docs, key, text, lambda t: _xml_rows(t, whole=False), "node last level kind title shown attributes columns cells")
    said = lambda n: F.when(n["shown"] != "", F.array(F.lit(""), n["shown"])).otherwise(_no_lines())
    bars = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    table = lambda n: F.when(n["columns"].isNotNull(), _table(n, n["columns"], bars)).otherwise(_no_lines())
    lines = lambda n: F.when(n["kind"] == BROKEN, _no_lines()).otherwise(F.concat(F.array(F.lit(""), _heading(n)), F.coalesce(n["attributes"], _no_lines()), said(n), table(n)))
    return _assembled(nodes, key, lines, lambda n: F.lit(False), contents)


def leaves(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, node, path, value): the leaves of JSON documents by paths such as a.b[0].c; empty containers are leaves below the top, a plain document's path is ``value``."""
    one = T.StructType().add("node", "long").add("path", "string").add("value", "string")
    return _rows(_parsed(docs, key, text, _json_leaves, one), key)


def flat_markdown(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): leaves by path, those of one first segment under its heading. Of equal paths the last counts. Broken texts give null."""
    one = T.StructType().add("first", "string").add("rest", "string").add("head", "string").add("value", "string")
    # A path without a dot is before one that ends in its only dot, as nulls are before empty texts.
    ordered = _parsed(docs, key, text, _last_leaves, one, _split_columns).select(key, F.sort_array("nodes").alias("nodes"))

    def part(n: Column, at: Column) -> Column:
        line = F.when(n["rest"] != "", F.concat(F.lit("- **"), n["rest"], F.lit(":** "), n["value"])).otherwise(F.concat(F.lit("- "), n["value"]))
        headed = F.concat(F.lit("## "), n["head"], F.lit("\n"), line)
        same = F.get("nodes", at - 1)["first"] == n["first"]
        return F.when(at == 0, headed).when(same, F.concat(F.lit("\n"), line)).otherwise(F.concat(F.lit("\n\n"), headed))

    return ordered.select(key, F.regexp_replace(F.array_join(F.transform("nodes", part), ""), r"\n{3,}", "\n\n").alias("text"))
