"""Front matter of Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def front_matter(fields: dict[str, Column]) -> Column:
    """A block of ``key: value`` lines in order of keys between dashes; nulls are left out."""
    lines = [F.when(fields[k].isNotNull(), F.concat(F.lit(f"{k}: "), fields[k].cast("string"))) for k in sorted(fields)]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def front_matter_field(text: Column, key: str) -> Column:
    """The value of a key in a text's front matter, null if there is none."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    return F.nullif(F.regexp_extract(block, rf"(?m)^{key}: (.*)$", 1), F.lit(""))
