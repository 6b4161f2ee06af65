"""Members of archives, and bytes as text."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2")


def _members(name: str, content: bytes, suffixes: tuple[str, ...], depth: int) -> Iterator[tuple[str, bytes]]:
    """Wanted members by name; archives inside are opened too while ``depth`` lasts. Names that leave the archive are skipped."""

    def each() -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                yield from ((i.name, t.extractfile(i).read()) for i in t if i.isfile())

    try:
        for inner, data in each():
            parts = inner.split("/")
            if inner.startswith("/") or ".." in parts or "__MACOSX" in parts or parts[-1] == ".DS_Store":
                continue
            if inner.lower().endswith(ARCHIVES) and depth > 0:
                yield from _members(f"{name}!{inner}", data, suffixes, depth - 1)
            elif inner.lower().endswith(suffixes):
                yield f"{name}!{inner}", data
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError):
        return


def archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".log", ".txt"), depth: int = 2) -> DataFrame:
    """(member, content) of the wanted files in all archives below ``path``; a broken archive gives what could be read.

    An archive is one task's work, for its members can't be reached without reading it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,tar,gz,tgz,bz2,tbz2}").load(path)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for member, data in _members(name, bytes(content), suffixes, depth):
                    yield pd.DataFrame({"member": [member], "content": [data]})

    return files.select("path", "content").mapInPandas(opened, "member string, content binary")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, with or without its mark, where valid, and Latin-1 otherwise."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(F.decode(content, "ISO-8859-1"))
