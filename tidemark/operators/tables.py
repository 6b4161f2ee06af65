"""Tables of cells, delimited files, names and paths, and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DELIMITERS = (",", ";", "\t", "|")


def sniffed_delimiter(spark: SparkSession, path: str, rows: int = 20) -> str:
    """The delimiter that most of the first lines hold equally often, more than once before fewer; a comma if none does."""
    heads = [r["value"] for r in spark.read.text(path).limit(rows).collect() if r["value"]]
    best, chosen = (0, 0), ","
    for mark in DELIMITERS:
        times = [line.count(mark) for line in heads]
        usual = max(set(times), key=lambda n: (times.count(n), n)) if times else 0
        score = (times.count(usual) if usual else 0, usual)
        if score > best:
            best, chosen = score, mark
    return chosen


def delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Rows of delimited files with a header; short rows are filled up with nulls, a byte order mark is dropped."""
    return spark.read.option("header", True).option("sep", delimiter or sniffed_delimiter(spark, path)).option("mode", "PERMISSIVE").csv(path)


def project(rows: DataFrame, names: list[str] | None = None, places: list[int] | None = None) -> DataFrame:
    """Columns by name, whatever their case and outer space, in the order asked for; by place; or by name where the place is allowed, too.

    An unknown name is an error.
    """
    if names is None:
        return rows if places is None else rows.select(*[rows.columns[p] for p in places])
    known = {c.strip().casefold(): p for p, c in reversed(list(enumerate(rows.columns)))}
    missing = [n for n in names if n.strip().casefold() not in known]
    if missing:
        raise ValueError(f"no such column: {missing}")
    found = [known[n.strip().casefold()] for n in names]
    return rows.select(*[rows.columns[p] for p in found if places is None or p in places])


def named(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose name is among ``names``, in any case."""
    return rows.where(F.lower(F.trim(column)).isin([n.strip().lower() for n in names]))


def cell_text(rows: DataFrame, column: str) -> Column:
    """A value as a table shows it: null and NaN are empty, whole numbers have no point, times are ISO, decimals no trailing zeros."""
    value, kind = F.col(column), rows.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        text = F.when(F.isnan(value), "").when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    elif isinstance(kind, T.DecimalType):
        text = F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1")
        text = F.regexp_replace(text, r"\.$", "")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    else:
        text = F.trim(value.cast("string"))
    return F.coalesce(text, F.lit(""))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


MARKS = {"left": ":---", "right": "---:", "center": ":---:"}


def gfm_table(rows: DataFrame, order: str, columns: list[str], alignment: list[str] | None = None) -> DataFrame:
    """(place, line): header, separator and a line a row of a Markdown table; rows whose cells are all empty are left out."""
    cells = [cell_text(rows, c) for c in columns]
    line = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    body = rows.where(F.concat(*cells) != "").select(F.col(order).cast("long").alias("place"), line([escaped(c) for c in cells]).alias("line"))
    marks = [MARKS[a] for a in (alignment + ["left"] * len(columns))[: len(columns)]] if alignment else ["---"] * len(columns)
    head = [(-2, "| " + " | ".join(c.replace("\\", "\\\\").replace("|", "\\|") for c in columns) + " |"), (-1, "| " + " | ".join(marks) + " |")]
    return rows.sparkSession.createDataFrame(head, "place long, line string").unionByName(body)


def printable_share(text: Column) -> Column:
    """The share of characters that are no control characters, tabs and line ends aside; 1 for the empty text."""
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.when(F.length(text) == 0, 1.0).otherwise(1 - odd / F.length(text))


def readable(texts: DataFrame, column: str = "text", least: float = 0.92) -> DataFrame:
    """Rows whose text isn't binary."""
    return texts.where(printable_share(F.col(column)) > least)


#: Ways to make a name of a text: what is replaced, by what, and how long the name may get.
SLUGS = {"service": (r"[^a-z0-9]+", "-", 80), "sheet": (r"[^a-z0-9_-]+", "_", 80), "url": (r"[^a-z0-9._-]+", "_", 140), "segment": (r"[^a-z0-9._-]+", "_", 120), "entry": (r"[^a-z0-9._-]+", "_", 180)}


def slug(text: Column, kind: str = "service") -> Column:
    """A file-safe name in lower case; without any safe character ``x``."""
    pattern, mark, size = SLUGS[kind]
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), pattern, mark), f"^{mark}+|{mark}+$", "")
    return F.coalesce(F.nullif(F.substring(name, 1, size), F.lit("")), F.lit("x"))


def normalized_url(url: Column) -> Column:
    """Without outer space and fragment."""
    return F.regexp_replace(F.trim(url), "#.*$", "")


def redacted_uri(uri: Column) -> Column:
    """User and password in front of a host as stars."""
    return F.regexp_replace(uri, r"(://)[^/@\s]+@", "$1***@")


def single_blank_lines(text: Column) -> Column:
    """Runs of blank lines as one, without blank lines at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"\n[ \t]*(\n[ \t]*)+", "\n\n"), r"^\s+|\s+$", "")


def cut_bytes(text: Column, size: int, notice: str = "\n[truncated]") -> Column:
    """At most ``size`` bytes of UTF-8, a character cut in two left out, and a notice if anything is."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, size)
    # Of the last character's bytes, an incomplete sequence goes: its lead byte and what follows.
    whole = [F.substring(raw, 1, size - k) for k in range(4)]
    kept = F.coalesce(*[F.when(F.is_valid_utf8(w.cast("string")), w.cast("string")) for w in whole], F.lit(""))
    return F.when(text.isNull() | (F.octet_length(text) <= size), text).otherwise(F.concat(kept, F.lit(notice)))


# Languages by file suffix.
LANGUAGES = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "tsx", "cpp": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp", "go": "go", "php": "php", "sql": "sql", "xml": "xml"}


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("mixed"))


def replaced(text: Column, table: dict[str, str]) -> Column:
    """Every key by its value, the longest keys first."""
    for key in sorted(table, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(key), F.lit(table[key]))
    return text


def relative_path(start: Column, target: Column) -> Column:
    """The way from a document to another: up to the shared folder and down again."""
    a, b = F.split(start, "/"), F.split(target, "/")
    up, down = F.slice(a, 1, F.size(a) - 1), F.slice(b, 1, F.size(b) - 1)
    lengths = F.sequence(F.lit(0), F.least(F.size(up), F.size(down)))
    shared = F.array_max(F.filter(lengths, lambda k: F.slice(up, F.lit(1), k) == F.slice(down, F.lit(1), k)))
    steps = F.array_repeat(F.lit(".."), (F.size(up) - shared).cast("int"))
    return F.array_join(F.concat(steps, F.slice(b, shared + 1, F.size(b))), "/")


def longest_text(rows: DataFrame, group: str, text: str, priority: str) -> DataFrame:
    """Of each group the longest text that isn't blank; of equal lengths the one of the smallest priority."""
    kept = rows.where(F.trim(text) != "")
    return kept.groupBy(group).agg(F.max_by(text, F.struct(F.length(text), -F.col(priority), text)).alias(text))


def headings(spans: DataFrame, page: str, size: str) -> DataFrame:
    """``spans`` with heading: at least 1.15 times the page's median size, and 1.5 above it."""
    middle = spans.groupBy(page).agg(F.median(size).alias("median"))
    return spans.join(middle, page).withColumn("heading", (F.col(size) >= 1.15 * F.col("median")) & (F.col(size) >= F.col("median") + 1.5))


def list_numbers(items: DataFrame, doc: str, place: str, level: str, levels: int = 9) -> DataFrame:
    """``items`` with number: a counter a level, that starts anew behind each item of a higher level (a smaller number)."""
    so_far = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(*[F.when(F.col(level) == k, F.max(F.when(F.col(level) < k, F.col(place))).over(so_far)) for k in range(1, levels + 1)])
    opened = items.withColumn("__above", F.coalesce(above, F.lit(-1)))
    inside = Window.partitionBy(doc, level, "__above").orderBy(place)
    return opened.withColumn("number", F.row_number().over(inside)).drop("__above")


def detected_format(path: Column, text: Column) -> Column:
    """json, xml or txt: by suffix, or else by the first character and whether the text parses."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    body = F.regexp_replace(text, "^\ufeff", "")
    first = F.substring(F.regexp_replace(body, r"^\s+", ""), 1, 1)
    is_json = first.isin("{", "[") & F.try_parse_json(body).isNotNull()
    is_xml = (first == "<") & F.regexp_replace(body, r"\s+$", "").endswith(">")
    return F.when(suffix.isin("json", "xml", "txt"), suffix).when(is_json, "json").when(is_xml, "xml").otherwise("txt")


def all_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several sources as one table, with the name of each row's source; a column that a source lacks is null there."""
    out = None
    for name, rows in parts.items():
        rows = rows.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def first_by_detail(rules: DataFrame, keys: list[str], detail: str, order: str, size: int = 120) -> DataFrame:
    """One row of each key and first ``size`` characters of the detail: the first by ``order``."""
    head = F.substring(detail, 1, size)
    return rules.groupBy(*keys, head.alias("head")).agg(F.min(F.struct(order, *[c for c in rules.columns if c not in keys and c != order])).alias("r")).select(*keys, "r.*")


def with_lineage(rows: DataFrame, run: str, source: str, keep_days: int) -> DataFrame:
    """``rows`` with where they come from, and for how long they are kept."""
    return rows.withColumns({"lineage_run": F.lit(run), "lineage_source": F.lit(source), "retention_days": F.lit(keep_days)})
