"""Symbols of Python sources."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYMBOLS = "path string, kind string, name string, owner string, line int"


def _found(tree: ast.AST, owner: str = "") -> Iterator[tuple[str, str, str, int]]:
    for node in ast.iter_child_nodes(tree):
        inner = owner
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = f"{owner}.{node.name}" if owner else node.name
            yield "class" if isinstance(node, ast.ClassDef) else "function", inner, owner, node.lineno
        elif isinstance(node, ast.Call):
            yield "call", ast.unparse(node.func), owner, node.lineno
        elif isinstance(node, ast.Import):
            yield from (("import", a.name, owner, node.lineno) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "import", "." * node.level + (node.module or ""), owner, node.lineno
        yield from _found(node, inner)


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, owner, line) of functions, classes, calls and imports in (path, text).

    The owner is the function or class around; a source that doesn't parse gives one row of kind ``error``.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += [(path, *row) for row in _found(ast.parse(text or ""))]
                except (SyntaxError, ValueError, RecursionError):
                    rows.append((path, "error", "", "", 0))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "owner", "line"])

    return files.select("path", "text").mapInPandas(parse, SYMBOLS)


def call_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst, relation) edges: CALLS from a function, IMPORTS from a file, CONTAINS from an owner."""
    return symbols.selectExpr(
        "CASE WHEN kind = 'import' OR owner = '' THEN path ELSE concat(path, '::', owner) END AS src",
        "CASE WHEN kind IN ('function', 'class') THEN concat(path, '::', name) ELSE name END AS dst",
        "CASE kind WHEN 'call' THEN 'CALLS' WHEN 'import' THEN 'IMPORTS' WHEN 'error' THEN NULL ELSE 'CONTAINS' END AS relation",
    ).where("relation IS NOT NULL")
