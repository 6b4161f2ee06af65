"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine walks the turns of a conversation in order and checks each role against the roles
that may follow; a turn out of order is formatted like any other, and marked.  Every turn
becomes text segments (opening mark, text, closing mark), each with a flag whether loss is
taken on it.  Control strings inside texts are broken up with an escape character, which
undoes exactly, so that the turns can be read back from the output alone.

Turns of a conversation are sorted, not gathered: a task holds one turn at a time, however
long the conversation.  Null roles and texts count as empty; a conversation's turns are
ordered by turn, role and text (nulls first), so that repeated rows each count.  Null
conversation ids are a conversation of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
_ESCAPED = re.compile(r"\\(\\?)")


class Marks(NamedTuple):
    """What stands around a role's texts, whether loss is taken on them, and who may speak next."""

    opening: str
    closing: str
    loss: bool
    next_roles: tuple[str, ...]


@dataclass(frozen=True)
class ChatTemplate:
    """Marks by role, the roles that may begin, and the marks of any other role, whose name is written out."""

    roles: dict[str, Marks]
    first_roles: tuple[str, ...]
    other_opening: str = "[TURN]"
    other_name_end: str = "[/ROLE]"
    other_closing: str = "[/TURN]"
    more_controls: tuple[str, ...] = field(default=())

    @cached_property
    def controls(self) -> tuple[str, ...]:
        marks = [m for r in self.roles.values() for m in (r.opening, r.closing)]
        return tuple(dict.fromkeys([*marks, self.other_opening, self.other_name_end, self.other_closing, *self.more_controls]))

    @cached_property
    def _starts(self) -> re.Pattern:
        """The first character of a control string, at every place where one stands, overlaps included."""
        return re.compile("(?=(?:" + "|".join(map(re.escape, self.controls)) + "))(.)", re.DOTALL)

    @cached_property
    def marks(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))))

    def escape(self, text: str) -> str:
        return self._starts.sub(lambda m: m[1] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))

    def unescape(self, text: str) -> str:
        return _ESCAPED.sub(r"\1", text) if ESCAPE in text else text

    def follows(self, role: str, before: str | None) -> bool:
        """The machine's step: may ``role`` speak after ``before`` (None: at the start)?"""
        if before is None:
            return role in self.first_roles
        return role in (self.roles[before].next_roles if before in self.roles else ())

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.roles:
            marks = self.roles[role]
            return [(marks.opening, False), (self.escape(text), marks.loss), (marks.closing, False)]
        opening = self.other_opening + self.escape(role) + self.other_name_end
        return [(opening, False), (self.escape(text), False), (self.other_closing, False)]


INSTRUCT = ChatTemplate(
    roles={
        "system": Marks("<<SYS>>", "<</SYS>>", False, ("user",)),
        "user": Marks("[INST]", "[/INST]", False, ("assistant",)),
        "assistant": Marks("<s>", "</s>", True, ("user",)),
    },
    first_roles=("system", "user"),
)


def format_turns(turns: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """(conv_id, seq, role, segment, loss, in_order): three segments a turn, numbered through the conversation."""
    ordered = _sorted(turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["conv_id", "turn", "role", "text"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before, seq, begun = None, None, 0, False
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv_id != conv:
                    conv, before, seq, begun = conv_id, None, 0, True
                in_order = template.follows(role, before)
                for segment, loss in template.segments(role, text):
                    for column, value in zip(out, (conv_id, seq, role, segment, loss, in_order), strict=True):
                        column.append(value)
                    seq += 1
                before = role
            kinds = (batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["conv_id", "seq", "role", "segment", "loss", "in_order"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(emit, f"conv_id {kind}, seq long, role string, segment string, loss boolean, in_order boolean")


def _sorted(frame: DataFrame, by: list[str]) -> DataFrame:
    return frame.repartition(by[0]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in by])


class _Reader:
    """Reads turns back from the formatted text of one conversation, segment by segment."""

    def __init__(self, template: ChatTemplate):
        self.template, self.open, self.role, self.name, self.text = template, None, "", None, []
        self.n, self.chars, self.loss_chars, self.in_order = 0, 0, 0, True
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.openings = {m.opening: (role, m.closing) for role, m in template.roles.items()} | {template.other_opening: (None, template.other_closing)}

    def feed(self, segment: str, loss: bool, in_order: bool) -> None:
        self.chars += len(segment)
        self.in_order &= in_order
        if loss:
            plain = self.template.unescape(segment)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        at = 0
        for mark in self.template.marks.finditer(segment):
            self.text.append(segment[at : mark.start()])
            at = mark.end()
            self.step(mark.group())
        self.text.append(segment[at:])

    def step(self, mark: str) -> None:
        text = self.template.unescape("".join(self.text))
        self.text = []
        if self.open is None:
            if text or mark not in self.openings:
                raise ValueError(f"{mark!r} opens no turn")
            self.role, self.open = self.openings[mark]
        elif self.role is None and mark == self.template.other_name_end:
            self.role = text
        elif mark == self.open and self.role is not None:
            self.turns.update(f"{self.role}\n{text}\n".encode())
            self.n, self.open = self.n + 1, None
        else:
            raise ValueError(f"{mark!r} inside a turn")

    def result(self) -> tuple:
        if self.open is not None:
            raise ValueError("the last turn isn't closed")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.in_order


def read_back(segments: DataFrame, template: ChatTemplate = INSTRUCT, placed: bool = False) -> DataFrame:
    """What the formatted text of each conversation holds: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, in_order).

    ``placed``: the segments come straight from ``format_turns``, whose order and partitions still hold.
    """
    used = segments.select("conv_id", "seq", "segment", "loss", "in_order")
    used = used if placed else _sorted(used, ["conv_id", "seq"])
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, kind = None, None, pa.int64()
        for batch in batches:
            done, kind = [], batch.column(0).type
            for conv_id, _, segment, loss, in_order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or conv_id != conv:
                    if reader:
                        done.append((conv, *reader.result()))
                    conv, reader = conv_id, _Reader(template)
                reader.feed(segment, loss, in_order)
            yield made(done, kind)
        if reader:
            yield made([(conv, *reader.result())], kind)

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    kind = segments.schema["conv_id"].dataType.simpleString()
    return used.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean")


def format_and_read(turns: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """Format all conversations, then read them back from the output."""
    return read_back(format_turns(turns, template), template, placed=True)
