"""Masks, fingerprints and classifiers of log text, as Column to Column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, labels and scores that results depend on.
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
NUMBER = r"\b\d+\b"
PATH = r"(?:[A-Za-z]:\\[^\s]+|/[^\s]+/[^\s]+)"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE = r"\b\+?\d[\d\s().-]{7,}\d\b"
JWT = r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"
AWS_KEY = r"\b(AKIA|ASIA)[0-9A-Z]{16}\b"
PATTERN_TAGS = {
    "auth_failure": r"(?i)auth(entication)?\s+failed|invalid\s+(credentials|token)|\b401\b|unauthorized",
    "sql_error": r"(?i)\bORA-\d+|syntax error|SQLITE_\w+|PostgreSQL|deadlock",
    "permission": r"(?i)permission denied|forbidden|\b403\b|access denied",
    "timeout": r"(?i)timeout|timed out|Read timed out",
    "network": r"(?i)connection refused|ECONNRESET|host unreachable|network error",
}
CLASSES = {"pii_detected": r"\b[\w.+-]+@[\w.-]+\.\w+\b", "auth_failure": r"(?i)\b(unauthorized|forbidden|auth failed|login failed)\b"}
SEVERITY_RANK = {"FATAL": 60, "ERROR": 50, "WARN": 40, "INFO": 30, "DEBUG": 20, "TRACE": 10}
SEVERITY_SCORE = {"FATAL": 60.0, "ERROR": 50.0, "WARN": 40.0, "WARNING": 40.0, "INFO": 20.0, "DEBUG": 10.0, "TRACE": 5.0}
UNKNOWN_LEVEL = 25
LEVEL_WORD = r"(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b"
#: Ids in messages, in the order in which they are looked for.
CORRELATION_IDS = (r"(?i)\btraceId[=:]?\s*([\w-]+)", r"(?i)\bspanId[=:]?\s*([\w-]+)", r"(?i)\brequestId[=:]?\s*([\w-]+)", r"(?i)\bcorrelation[_-]?id[=:]?\s*([\w-]+)")
FIELD = r"(?i)\b{head}[_-]?{tail}[=:]?\s*([\w-]+)"
#: Lines of a stack trace: a frame, a cause, a line of the runtime, an exception's head, or a count of frames left out.
STACK_LINES = (r"^\s*at ", r"^\s*Caused by:", r"^java\.lang\.", r"\.reflect\.", r"^\s*[a-zA-Z][\w.$]*(?:Exception|Error)(?::|\s*$)", r"^\.\.\. .* more")
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][,SSS]", "yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z", "yyyy-MM-dd")


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER, "<NUM>")


def mask_uuids(text: Column) -> Column:
    return F.regexp_replace(text, UUID, "<UUID>")


def mask_paths(text: Column) -> Column:
    return F.regexp_replace(text, PATH, "<PATH>")


def mask_ips(text: Column) -> Column:
    return F.regexp_replace(text, IP, "<IP>")


def redact(text: Column) -> Column:
    """E-mail addresses, phone numbers, tokens and keys, in that order."""
    for pattern, name in ((EMAIL, "EMAIL"), (PHONE, "PHONE"), (JWT, "JWT"), (AWS_KEY, "AWS_KEY")):
        text = F.regexp_replace(text, pattern, f"<{name}>")
    return text


def normalize(text: Column, pii: bool = True, uuids: bool = True, numbers: bool = True, paths: bool = True) -> Column:
    """The masks that are asked for, always in this order."""
    for wanted, mask in ((pii, redact), (uuids, mask_uuids), (numbers, mask_numbers), (paths, mask_paths)):
        text = mask(text) if wanted else text
    return text


def stable_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def record_fingerprint(level: Column, message: Column) -> Column:
    return stable_hash(F.concat_ws("|", level, message))


def dedupe_fingerprint(level: Column, logger: Column, message: Column) -> Column:
    """A missing logger counts as the text None."""
    return stable_hash(F.concat_ws("|", level, F.coalesce(logger, F.lit("None")), message))


def _lookup(value: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for key, found in reversed(table.items()):
        out = F.when(F.upper(value) == key, F.lit(found)).otherwise(out)
    return out


def severity_rank(level: Column) -> Column:
    return _lookup(level, SEVERITY_RANK, UNKNOWN_LEVEL)


def severity_score(level: Column) -> Column:
    """The share of a single record in an incident's score."""
    return _lookup(level, SEVERITY_SCORE, float(UNKNOWN_LEVEL))


def tags(text: Column, table: dict[str, str]) -> Column:
    """Sorted names of the patterns that match."""
    found = F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in sorted(table.items())])
    return F.filter(found, lambda x: x.isNotNull())


def field(text: Column, name: str) -> Column:
    """The value behind ``name`` or ``name_`` variants such as trace_id=, null if there is none."""
    head, tail = name.split("_")
    return _first_group(text, FIELD.format(head=head, tail=tail))


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def correlation_id(text: Column) -> Column:
    """The first of the ids that a message holds: of trace, span, request or correlation."""
    return F.coalesce(*[_first_group(text, p) for p in CORRELATION_IDS])


def scan_level(text: Column) -> Column:
    """The first level that a text names, in capitals; WARNING is WARN, none is null."""
    word = F.upper(_first_group(text, LEVEL_WORD))
    return F.when(word == "WARNING", "WARN").otherwise(word)


def without_level(text: Column) -> Column:
    """The text without the first level that it names."""
    rest = F.regexp_replace(text, r"(?is)^(.*?)\b(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b", "$1")
    return F.regexp_replace(rest, r"^\s+|\s+$", "")


def parse_timestamp(text: Column) -> Column:
    """A timestamp in the first of ``TIME_FORMATS`` that fits, null if none does."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in TIME_FORMATS])


def is_stack_line(text: Column) -> Column:
    found = F.lit(False)
    for pattern in STACK_LINES:
        found = found | text.rlike(pattern)
    return (F.trim(text) != "") & found


def _entropy(text: str | None) -> float:
    if not text:
        return 0.0
    _, times = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    p = times / len(text)
    return float(-(p * np.log2(p)).sum() / (np.log2(min(len(text), 256)) or 1.0))


def char_entropy(text: Column) -> Column:
    """Shannon entropy of characters over that of a text as long with all of them different; 0 for the empty text.

    Counting characters has no built-in function, so that texts go through Arrow.
    """

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(_entropy).astype("float64")

    return F.pandas_udf(of, "double")(text)
