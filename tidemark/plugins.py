"""Ways to add to the engine: enrichers, parsers, chunkers and stages, by name or from ``module:attribute``."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from importlib import import_module
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import all_sources

Step = Callable[[DataFrame], DataFrame]


def loaded(names: list[str]) -> list[Callable]:
    """What ``module:attribute`` names; a name that can't be loaded is left out."""
    found = []
    for name in names:
        module, _, attribute = name.partition(":")
        try:
            found.append(getattr(import_module(module), attribute))
        except (ImportError, AttributeError, ValueError):
            continue
    return found


def enriched(records: DataFrame, enrichers: list[Step]) -> DataFrame:
    """``records`` through every enricher, a function from frame to frame, so that Catalyst sees them as one plan."""
    for step in enrichers:
        records = records.transform(step)
    return records


class Parser(Protocol):
    """Rows of a text; the first parser that can read a sample of it is taken."""

    schema: str

    def can_parse(self, sample: str) -> bool: ...

    def parse(self, text: str) -> Iterator[dict]: ...


def parsed(files: DataFrame, parsers: list[Parser], schema: str, sample: int = 4096) -> DataFrame:
    """Rows of (path, text) files by the first parser that takes a file's head; files that none takes have no rows."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                chosen = next((p for p in parsers if p.can_parse((text or "")[:sample])), None)
                rows += [{"path": path, **row} for row in chosen.parse(text or "")] if chosen else []
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(run, schema)


class Lifecycle(Protocol):
    """Set up once a task, called for each batch, closed at the end, whatever happens."""

    def initialize(self) -> None: ...

    def process(self, batch: pd.DataFrame) -> pd.DataFrame: ...

    def finalize(self) -> None: ...


def with_lifecycle(rows: DataFrame, make: Callable[[], Lifecycle], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plugin = make()
        plugin.initialize()
        try:
            yield from map(plugin.process, batches)
        finally:
            plugin.finalize()

    return rows.mapInPandas(run, schema)


class Registry:
    """Functions from frame to frame by name."""

    def __init__(self, **known: Step):
        self.known = dict(known)

    def add(self, name: str) -> Callable[[Step], Step]:
        def keep(step: Step) -> Step:
            self.known[name] = step
            return step

        return keep

    def run(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """The results of all named functions as one table, with the name of each row's."""
        return all_sources({name: self.known[name](rows) for name in names})


def run_stages(rows: DataFrame, stages: list[tuple[str, Step]], cancelled: Callable[[], bool] = lambda: False) -> tuple[DataFrame, list[tuple[str, float]]]:
    """``rows`` through named stages, until one is cancelled; with the seconds that planning each took."""
    took = []
    for name, stage in stages:
        if cancelled():
            break
        began = time.monotonic()
        rows = stage(rows)
        took.append((name, time.monotonic() - began))
    return rows, took


def encoded(rows: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]], size: int = 64) -> DataFrame:
    """``rows`` with vector, by a function from texts to vectors that is called with at most ``size`` texts."""
    def every(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for at in range(0, len(texts), size):
            out += encode(texts.iloc[at : at + size].fillna("").tolist())
        return pd.Series(out, index=texts.index)

    return rows.withColumn("vector", F.pandas_udf(every, "array<double>")(text))
