"""Nested values as paths."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict) and value:
        for key, inner in value.items():
            yield from leaves(inner, f"{path}.{key}" if path else key)
    elif isinstance(value, list) and value:
        for k, inner in enumerate(value):
            yield from leaves(inner, f"{path}[{k}]")
    else:
        yield path, value if isinstance(value, str) else json.dumps(value)


def json_leaves(text: Column) -> Column:
    """An array of (path, value): paths such as a.b[0].c with their values as text.

    Numbers stay as written, empty objects and lists too, null is ``null``; a plain document's path is ``value``.
    Texts that aren't JSON give no paths, nor does an empty container as a whole document.
    """

    def of(text: str | None) -> list[dict]:
        try:
            value = json.loads(text or "", parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            return []
        if value in ({}, []):
            return []
        return [{"path": p or "value", "value": v} for p, v in leaves(value)]

    def all_of(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return F.pandas_udf(all_of, "array<struct<path:string,value:string>>")(text)
