"""The merged schema of nested JSON documents."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import stored

#: Containers inside each other that are followed; what lies deeper counts as its container alone.
MAX_DEPTH = 64
#: Paths with their kinds of different documents that a task holds before it hands on what it has counted.
HELD_PATHS = 100_000
_KINDS = {dict: "object", list: "array", type(None): "null", bool: "bool", str: "string", float: "float"}
_decoder = json.JSONDecoder(strict=False)


def json_kind(value: object) -> str:
    """null, bool, int, float, string, array or object; whole numbers of more than 38 digits are floats, as in a variant."""
    return _KINDS.get(type(value)) or ("int" if abs(value) < 10**38 else "float")


def json_paths(value: object) -> set[tuple[str, str]]:
    """The distinct (path, kind) of all that a document holds below its top: members by name, elements by brackets; an empty list holds a null.

    A plain value or an empty object as a whole document has none.
    """
    found, waiting = set(), [(value, "", 0)]
    while waiting:
        one, path, depth = waiting.pop()
        if isinstance(one, dict):
            inside = [(f"{path}.{k}" if path else k, v) for k, v in one.items()]
        else:
            inside = [(f"{path}[]", v) for v in one or [None]] if isinstance(one, list) else []
        found.update((name, json_kind(v)) for name, v in inside)
        if depth + 1 < MAX_DEPTH:
            waiting += [(v, name, depth + 1) for name, v in inside if isinstance(v, (dict, list))]
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, kinds, n) of a task's documents, and a row without a path that counts them. Documents with the same paths and kinds are counted together."""
    shapes: Counter[frozenset] = Counter()
    held = 0

    def told() -> pa.RecordBatch:
        n, kinds = Counter({None: shapes.total()}), defaultdict(set)
        for shape, times in shapes.items():
            for path, kind in shape:
                kinds[path].add(kind)
            n.update(dict.fromkeys({path for path, _ in shape}, times))
        # Halves of surrogates have no UTF-8.
        paths = [p if p is None else p.encode("utf-8", "replace").decode() for p in n]
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([sorted(kinds[p]) for p in n], pa.list_(pa.string())), pa.array(list(n.values()), pa.int64())], ["path", "kinds", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            # What stands behind a document is left alone, as when it is parsed as a variant.
            shape = frozenset(json_paths(_decoder.raw_decode(text.lstrip(" \t\r\n"))[0]))
            held += len(shape) if shape not in shapes else 0
            shapes[shape] += 1
            if held > HELD_PATHS:
                yield told()
                shapes.clear()
                held = 0
    if shapes:
        yield told()


def merged_schema(rows: DataFrame, column: str) -> DataFrame:
    """(path, types, n, share): each path of the documents, such as a.b[].c, the kinds that occur there joined by |, and in how many documents it is, of all that are JSON.

    Texts are read once; a task hands on a row a path, not a row a document.
    """
    parsed = rows.select(F.col(column).alias("text")).where(F.try_parse_json(column).isNotNull())
    counts = stored(parsed.mapInArrow(_counted, "path string, kinds array<string>, n long"), "schema-counts")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))), "|")
    held = counts.where("path IS NOT NULL").groupBy("path").agg(kinds.alias("types"), F.sum("n").alias("n"))
    total = F.broadcast(counts.where("path IS NULL").agg(F.sum("n").alias("documents")))  # one row
    return held.crossJoin(total).select("path", "types", "n", F.round(F.col("n") / F.col("documents"), 6).alias("share"))
