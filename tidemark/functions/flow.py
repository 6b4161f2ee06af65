"""Control flow, entries and rules of sources: rows from each file's own text, over batches of files."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import language

STEPS = "path string, method string, node int, kind string, label string, line int, dst int, branch string"
RULES = "path string, symbol string, kind string, detail string, line int"
#: Steps of a method beyond which its graph ends with a step of kind ``cut``.
MOST_STEPS = 500

# What marks an entry of a program in its text.
ENTRIES = (
    ("api_rest", r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\b|@(?:app|router|bp|blueprint)\.(?:get|post|put|delete|patch|route)\("),
    ("kafka", r"@KafkaListener\b|KafkaConsumer\("),
    ("scheduler", r"@Scheduled\b|@(?:celery|app)\.task\b"),
    ("portlet", r"extends\s+(?:MVCPortlet|GenericPortlet)\b"),
    ("main", r"""if __name__ == ["']__main__["']|public\s+static\s+void\s+main\s*\("""),
    ("cli", r"@(?:click\.command|app\.command)\b|ArgumentParser\("),
)
TRIGGER = r"(?i)create\s+(?:or\s+replace\s+)?trigger\s+([\w.\"]+)"


class _Flow:
    """The control-flow graph of one function: steps by number, and edges with the branch they stand for."""

    def __init__(self):
        self.steps: list[tuple[str, str, int]] = []
        self.edges: list[tuple[int, int, str]] = []
        self.loops: list[tuple[int, list[tuple[int, str]]]] = []
        self.exits: list[tuple[int, str]] = []

    def step(self, kind: str, label: str, line: int, before: list[tuple[int, str]]) -> list[tuple[int, str]]:
        self.steps.append((kind, label, line))
        self.edges += [(b, len(self.steps) - 1, branch) for b, branch in before]
        return [(len(self.steps) - 1, "next")]

    def body(self, statements: list[ast.stmt], before: list[tuple[int, str]]) -> list[tuple[int, str]]:
        for statement in statements:
            if not before:
                break  # nothing behind a return is reached
            if len(self.steps) >= MOST_STEPS:
                return self.step("cut", "truncated", statement.lineno, before)
            before = self.statement(statement, before)
        return before

    def statement(self, s: ast.stmt, before: list[tuple[int, str]]) -> list[tuple[int, str]]:
        line = s.lineno
        if isinstance(s, ast.If):
            at = self.step("if", ast.unparse(s.test), line, before)[0][0]
            return self.body(s.body, [(at, "true")]) + self.body(s.orelse, [(at, "false")])
        if isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            label = ast.unparse(s.test) if isinstance(s, ast.While) else f"{ast.unparse(s.target)} in {ast.unparse(s.iter)}"
            at = self.step("loop", label, line, before)[0][0]
            self.loops.append((at, []))
            self.edges += [(b, at, "repeat") for b, _ in self.body(s.body, [(at, "true")])]
            _, broken = self.loops.pop()
            return self.body(s.orelse, [(at, "exit")]) + broken
        if isinstance(s, ast.Match):
            at = self.step("switch", ast.unparse(s.subject), line, before)[0][0]
            ends = [end for case in s.cases for end in self.body(case.body, [(at, ast.unparse(case.pattern))])]
            whole = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None for c in s.cases)
            return ends if whole else [*ends, (at, "no case")]
        if isinstance(s, (ast.Try, ast.TryStar)):
            at = self.step("try", "try", line, before)
            ends = self.body([*s.body, *s.orelse], at)
            for handler in s.handlers:
                ends += self.body(handler.body, [(at[0][0], f"except {ast.unparse(handler.type)}" if handler.type else "except")])
            return self.body(s.finalbody, ends)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self.body(s.body, self.step("with", ", ".join(map(ast.unparse, s.items)), line, before))
        if isinstance(s, (ast.Return, ast.Raise)):
            self.exits += self.step("return" if isinstance(s, ast.Return) else "raise", ast.unparse(s), line, before)
            return []
        if isinstance(s, (ast.Break, ast.Continue)) and self.loops:
            at, broken = self.loops[-1]
            if isinstance(s, ast.Break):
                broken += [(b, "break") for b, _ in before]
            else:
                self.edges += [(b, at, "repeat") for b, _ in before]
            return []
        kind = "call" if any(isinstance(n, ast.Call) for n in ast.walk(s)) else "step"
        return self.step(kind, ast.unparse(s).split("\n")[0][:200], line, before)


def _flow_rows(tree: ast.AST) -> Iterator[tuple]:
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            flow = _Flow()
            ends = flow.body(node.body, flow.step("start", node.name, node.lineno, []))
            flow.step("end", "end", node.end_lineno or node.lineno, ends + flow.exits)
            out: dict[int, list[tuple[int, str]]] = {}
            for a, b, branch in flow.edges:
                out.setdefault(a, []).append((b, branch))
            for k, (kind, label, line) in enumerate(flow.steps):
                for dst, branch in out.get(k, [(-1, "")]):
                    yield node.name, k, kind, label, line, dst, branch


def _rule_rows(tree: ast.AST, owner: str = "") -> Iterator[tuple[str, str, str, int]]:
    for node in ast.iter_child_nodes(tree):
        inner = f"{owner}.{node.name}".lstrip(".") if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else owner
        if isinstance(node, ast.Raise):
            yield inner, "raise", ast.unparse(node.exc) if node.exc else "raise", node.lineno
        elif isinstance(node, ast.Assert):
            yield inner, "validation", ast.unparse(node.test), node.lineno
        elif isinstance(node, ast.If):
            yield inner, "branch", ast.unparse(node.test), node.lineno
        yield from _rule_rows(node, inner)


def _by_file(files: DataFrame, rows: Callable[[ast.AST], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of each Python file that parses."""
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    found += [(path, *row) for row in rows(ast.parse(text or ""))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(found, columns=names)

    return files.select("path", "text").mapInPandas(parse, schema)


def control_flow(files: DataFrame) -> DataFrame:
    """A row for each edge of the control-flow graph of each function in (path, text): a step, and dst, the step that may follow, -1 behind the end."""
    return _by_file(files, _flow_rows, STEPS)


def business_rules(files: DataFrame) -> DataFrame:
    """(path, symbol, kind, detail, line): what Python sources raise, demand and branch on, and triggers of SQL; equal ones of a symbol are one."""
    code = _by_file(files.where(language(F.col("path")) == "python"), _rule_rows, RULES)
    sql = files.where(language(F.col("path")) == "sql").select("path", F.explode(F.regexp_extract_all("text", F.lit(TRIGGER), F.lit(1))).alias("symbol"))
    triggers = sql.select("path", "symbol", F.lit("trigger").alias("kind"), F.lit("").alias("detail"), F.lit(0).alias("line"))
    return code.unionByName(triggers).groupBy("path", "symbol", "kind", F.substring("detail", 1, 120).alias("detail")).agg(F.min("line").alias("line"))


def entries(files: DataFrame) -> DataFrame:
    """(path, kind, n): the kinds of entries that a source's text marks, and how often."""
    counts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_count("text", F.lit(p)).alias("n")) for kind, p in ENTRIES])
    return files.select("path", F.inline(F.filter(counts, lambda c: c["n"] > 0)))
