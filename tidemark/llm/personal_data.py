"""Personal data with offset-preserving deobfuscation.

Base detectors find e-mail addresses, IP addresses, card and phone numbers in the text as it
stands.  A transducer then rewrites disguises (homoglyphs, invisible characters, spelled
digits, at/dot words) and keeps for every rewritten character the source characters it came
from; the same detectors run over the rewritten text, and what they find is mapped back to
source offsets.  Base spans always stay; a mapped span is added unless it lies wholly inside a
base span of its kind, so that of a half-disguised identifier both the plain part and the whole
are listed.  Redaction replaces the union of overlapping spans.

Offsets count code points, ends are exclusive.  Null text counts as empty, and whole texts
are read, however long; names, hosts and runs of digits may have any length, and all steps run in time
linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import merge
from io import StringIO
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A digit run can only match from its first digit on, for a match takes all of its last run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From one @ to the next, so that long runs without one are not tried at every position."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans by start, then kind; failing matches are dropped without another try."""
    found = [Span(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(Span(m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGITS.sub("", m.group())
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(Span(m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                    found.append(Span(m.start(), 3, m.end()))
        found.sort()
    return found


# Letters of other scripts that look like ASCII letters, and digit words.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "∙": ".", "․": ".", "。": ".",
}
_DIGIT_WORDS = {
    w: str(n)
    for words in (
        "zero one two three four five six seven eight nine",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, w in enumerate(words.split())
}
_INVISIBLE = "­​‌‍⁠﻿"
_ODD = re.compile("[ ­²³¹Ͱ-ԯ؀-ۿऀ-ॿ -⿿　-〿＀-￯﻿\U0001d400-\U0001d7ff]")
#: "at" or "dot" in brackets; white space around it belongs to it.
_BRACKETED = re.compile(r"[\[({<]\s*+(?:(?P<at>at|@|chez|arroba)|dot|\.|point|punkt|punto)\s*+[\])}>]", re.IGNORECASE)
#: A bare "at", or "at sign", with what may be a host behind it: labels joined by "dot" or by dots.
_AT_HOST = re.compile(r"(?<=\s)at(?P<sign>[-\s]sign)?\s++(?P<host>[A-Za-z0-9-]++(?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)++)", re.IGNORECASE)
#: The same with underscores for blanks, where the dots are spelled, too.
_UNDERSCORED = re.compile(r"(?<=[A-Za-z0-9])_++at_++(?P<host>[A-Za-z0-9-]++(?:_++dot_++[A-Za-z0-9-]++)++)", re.IGNORECASE)
_UNDERSCORED_DOT = re.compile(r"_++dot_++", re.IGNORECASE)
_HOST_DOT = re.compile(r"\s++dot\s++", re.IGNORECASE)
# Ends of hosts that count in any mixture of cases.
_KNOWN_ENDS = "com org net edu gov info biz name io co eu de fr es it nl be ch at uk us ca au pt pl se"
#: The end of a host that is written with plain dots.
_HOST_END = re.compile(rf"\.(?:[a-z]{{2,}}|[A-Z]{{2,}}|(?i:{_KNOWN_ENDS.replace(' ', '|')}))$")
# Words that no host starts with, and words before "at" that are no one's name.
_NOT_HOSTS = frozenset("the a an this that www".split())
_NOT_NAMES = frozenset(
    "a all and are arrive arrived as available based be been best both buy by call check click done even event find follow found get "
    "go good have help here hosted i in is it join just listed live located look looked looking made me meet more not of offered on only open "
    "or out page posted published read reach register seen see site sold start still that the them there they this time "
    "to today up us view visit was we website were what when where with work works you".split()
)
_CHUNK = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"[0-9]+|[^\W\d_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DOT_BETWEEN = re.compile(r"\s*+\.\s*+")
_GAP = re.compile(r"[\s,()-]*+")
_SPELL_WORDS = frozenset(_DIGIT_WORDS) | {"dot"}
#: A run with spelled parts counts from so many digits, or dots, on.
_LEAST_DIGITS, _LEAST_DOTS = 7, 3
_CASELESS = str.maketrans("İıſ", "iis")
#: Letters of Latin-1 in lower case, blanks for all else; what Latin-1 lacks comes as a question mark, and parts words, too.
_LATIN_WORDS = bytes(ord(c.lower()) if (c := chr(b)).isalpha() and ord(c.lower()) < 256 else 32 for b in range(256))
_SPELL_BYTES = frozenset(w.encode("latin-1") for w in _SPELL_WORDS)
#: The same with digits as they are, blanks for what may stand inside a run, bars for the rest.
_LATIN_PARTS = bytes(b if 48 <= b <= 57 else 32 if chr(b) in ",()-." or chr(b).isspace() else _LATIN_WORDS[b] if _LATIN_WORDS[b] != 32 else 124 for b in range(256))
_DIGIT_BYTE = re.compile(rb"[0-9]")
#: A dot between digits that has blanks before it.
_SPACED_DOT = re.compile(r"[0-9]\s++\.\s*+[0-9]")


@lru_cache(maxsize=4096)
def _plain(char: str) -> str:
    """What an odd character stands for: itself, an ASCII character or nothing."""
    if char in _INVISIBLE:
        return ""
    if char in _LOOKALIKES:
        return _LOOKALIKES[char]
    folded = unicodedata.normalize("NFKC", char)
    if len(folded) == 1 and folded.isascii():
        return folded
    digit = unicodedata.digit(char, None)
    return char if digit is None else str(digit)


class Edit(NamedTuple):
    start: int
    end: int
    new: str


class _Stage:
    """Edits by their places in the text before and after them: what maps a place back, in some 32 bytes an edit."""

    def __init__(self) -> None:
        self.starts, self.ends, self.new_starts, self.new_ends = array("q"), array("q"), array("q"), array("q")

    def low(self, at: int) -> int:
        """Where the character at a place starts in the text before."""
        k = bisect_right(self.new_starts, at) - 1
        if k < 0:
            return at
        return self.starts[k] if at < self.new_ends[k] else at - self.new_ends[k] + self.ends[k]

    def high(self, at: int) -> int:
        """Where the character at a place ends in the text before."""
        k = bisect_right(self.new_starts, at) - 1
        if k < 0:
            return at + 1
        return self.ends[k] if at < self.new_ends[k] else at - self.new_ends[k] + self.ends[k] + 1

    def within(self, start: int, end: int) -> bool:
        """Whether an edit put any of the characters of a range there."""
        k = bisect_right(self.new_ends, start)
        while k < len(self.starts) and self.new_starts[k] < end:
            if self.new_ends[k] > self.new_starts[k]:
                return True
            k += 1
        return False


class Mapped:
    """A text made by stages of edits, whose ranges map back to the source."""

    def __init__(self, text: str):
        self.out, self.stages = text, []

    def edit(self, edits: Iterable[Edit]) -> None:
        """Puts edits in, given in order of their starts; of overlapping ones the first."""
        stage, out, at, size = _Stage(), StringIO(), 0, 0
        for start, end, new in edits:
            if start < at:
                continue
            out.write(self.out[at:start])
            out.write(new)
            size += start - at
            for column, value in ((stage.starts, start), (stage.ends, end), (stage.new_starts, size), (stage.new_ends, size + len(new))):
                column.append(value)
            size += len(new)
            at = end
        if stage.starts:
            out.write(self.out[at:])
            self.out = out.getvalue()
            self.stages.append(stage)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source range of a range, and whether any of its characters was put there by an edit."""
        changed = False
        for stage in reversed(self.stages):
            changed = changed or stage.within(start, end)
            start, end = stage.low(start), stage.high(end - 1)
        return start, end, changed


def _lower(text: str) -> str:
    """The text in lower case, with the three letters that patterns without case take for an ASCII one."""
    return (text.translate(_CASELESS) if any(c in text for c in "İıſ") else text).lower()


def _may_spell(text: str) -> bool:
    """Whether a text can hold a run with spelled parts: no such run lacks a digit word, or a "dot", beside another one or a digit."""
    if any(c in text for c in "İıſ"):
        text = _lower(text)
    at, last = 0, 0  # last: 1 if a digit word ends what has been read, 2 if a digit
    while at < len(text):
        end = min(at + 65536, len(text))
        most = min(end + 64, len(text))
        while end < most and text[end].isalnum():  # longer than any digit word
            end += 1
        piece, at = text[at:end].encode("latin-1", "replace"), end
        parts = piece.translate(_LATIN_PARTS)
        if _SPELL_BYTES.isdisjoint(piece.translate(_LATIN_WORDS).split()):
            ended = parts.rstrip()
            if ended:
                # A piece that starts with a digit may follow on a digit word of the one before it.
                if last == 1 and parts.lstrip()[:1].isdigit():
                    return True
                last = 2 if ended[-1:].isdigit() else 0
            continue
        for part in parts.replace(b"|", b" | ").split():
            if part in _SPELL_BYTES:
                if last:
                    return True
                last = 1
            elif part.isalpha() or not _DIGIT_BYTE.search(part):
                last = 0
            else:  # with digits
                if last == 1 or not part.isdigit() and not _SPELL_BYTES.isdisjoint(part.translate(_LATIN_WORDS).split()):
                    return True
                last = 2
    return False


def _disguised(text: str) -> bool:
    """A cheap test that no text with a disguise fails."""
    if not text.isascii() and _ODD.search(text):
        return True
    if any(c in text for c in "[({<") and _BRACKETED.search(text):
        return True
    if _AT_HOST.search(text) or "_" in text and _UNDERSCORED.search(text):
        return True
    return _may_spell(text) or _SPACED_DOT.search(text) is not None


def _bracketed(text: str) -> Iterator[Edit]:
    """Bracketed words with the white space around them."""
    done = 0
    for m in _BRACKETED.finditer(text):
        start, end = m.span()
        while start > done and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        done = end
        yield Edit(start, end, "@" if m["at"] else ".")


def _underscored(text: str) -> Iterator[Edit]:
    """``name_at_host_dot_tld``."""
    for m in _UNDERSCORED.finditer(text):
        yield Edit(m.start(), m.start("host"), "@")
        yield from (Edit(d.start(), d.end(), ".") for d in _UNDERSCORED_DOT.finditer(text, m.start("host"), m.end()))


def _bare(text: str) -> Iterator[Edit]:
    """Addresses with a bare "at": ``name dot name at host dot tld``, or ``name at host.tld``.

    A host needs a spelled dot, or "at sign" before it, or an end in letters of one case (or a common one) and a name
    that isn't a common word before "at", or "at" would be taken in any sentence.
    """
    for m in _AT_HOST.finditer(text):
        host = m["host"]
        dots = list(_HOST_DOT.finditer(text, m.start("host"), m.end()))
        sure = dots or m["sign"]
        if _lower(re.split(r"[\s.]", host, maxsplit=1)[0]) in _NOT_HOSTS or not sure and not _HOST_END.search(host):
            continue
        left, parts = m.start(), []
        while True:  # names joined by "dot", from right to left
            end = left
            while end and text[end - 1].isspace():
                end -= 1
            start = end
            while start and text[start - 1] in _LOCAL:
                start -= 1
            if start == end:
                break
            if not parts:
                if not sure and _lower(text[start:end].rstrip(".,")) in _NOT_NAMES:
                    break
                parts.append(Edit(end, m.start("host"), "@"))
            before = _dot_before(text, start)
            if before is None:
                break
            parts.append(Edit(before, start, "."))
            left = before
        if parts:
            yield from parts
            yield from (Edit(d.start(), d.end(), ".") for d in dots)


def _dot_before(text: str, at: int) -> int | None:
    """Where a name ends that a word "dot", with white space on both sides, joins to what starts at ``at``."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = before = end - 3
    if end == at or start < 2 or _lower(text[start:end]) != "dot":
        return None
    while before and text[before - 1].isspace():
        before -= 1
    return before if before < start and before and text[before - 1] in _LOCAL else None


class _Run:
    """Digits and digit words with separators between them, up to the next thing that is neither.

    Edits wait in an array, three numbers each, until the run is sure to count.
    """

    def __init__(self, text: str, start: int):
        self.digits = self.dots = self.spelled = self.spaced = 0
        self.waiting = array("q")
        at = start
        while at and text[at - 1].isspace():
            at -= 1
        if at < start and _lower(text[max(0, at - 4) : at])[-4:] == "plus" and (at == 4 or not text[at - 5].isalnum()):
            self.put(at - 4, start, "+")

    def put(self, start: int, end: int, new: str) -> None:
        self.waiting.extend((start, end, ord(new) if new else -1))

    def take(self) -> Iterator[Edit]:
        """The edits that wait, once the run counts."""
        if self.spelled and (self.digits >= _LEAST_DIGITS or self.dots >= _LEAST_DOTS) or self.spaced and self.dots >= _LEAST_DOTS:
            for k in range(0, len(self.waiting), 3):
                start, end, new = self.waiting[k : k + 3]
                yield Edit(start, end, "" if new < 0 else chr(new))
            self.waiting = array("q")


def _digits(text: str, start: int, end: int) -> tuple[int, list[Edit]] | None:
    """How many digits a word holds, and its spelled ones; None if it holds anything else."""
    n, edits = 0, []
    for part in _PARTS.finditer(text, start, end):
        if part.group()[0] in "0123456789":
            n += part.end() - part.start()
            continue
        digit = _DIGIT_WORDS.get(_lower(part.group()))
        if digit is None:
            return None
        n += 1
        edits.append(Edit(part.start(), part.end(), digit))
    return (n, edits) if n else None


def _spelled(text: str) -> Iterator[Edit]:
    """Spelled digits, with the separators between digits taken out and dots between them put in."""
    run: _Run | None = None
    last, dot = 0, False  # where the run ends so far, and whether a word "dot" stands behind it
    for m in _CHUNK.finditer(text):
        start, end = m.span()
        got = _digits(text, start, end)
        if got is None:
            if run is not None and not dot and end - start == 3 and _lower(m.group()) == "dot" and last < start and text[last:start].isspace():
                dot, dot_end = True, end
                continue
            run, dot = None, False
            continue
        if run is not None:
            new = ""
            if dot:
                joined = dot_end < start and text[dot_end:start].isspace()
                new = "."
            elif _DOT_BETWEEN.fullmatch(text, last, start):
                joined, new = True, "."
            else:
                joined = _GAP.fullmatch(text, last, start) is not None
            if not joined:
                run = None
            else:
                run.dots += new == "."
                run.spelled += dot
                run.spaced += new == "." and text[last].isspace()
                if text[last:start] != new:
                    run.put(last, start, new)
        if run is None:
            run = _Run(text, start)
        run.digits += got[0]
        run.spelled += len(got[1])
        for edit in got[1]:
            run.put(*edit)
        yield from run.take()
        last, dot = end, False


def rewrite(text: str) -> Mapped:
    """The text with disguises undone: single characters first, then words."""
    plain = Mapped(text)
    if not text.isascii():
        plain.edit(Edit(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _plain(m.group())) != m.group())
    plain.edit(merge(_bracketed(plain.out), _underscored(plain.out), sorted(_bare(plain.out)), _spelled(plain.out)))
    return plain


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that deobfuscation adds."""
    base = detect(text)
    if not _disguised(text):
        return base, []
    plain, added = rewrite(text), []
    # Spans of a kind never overlap: of those that start at or before a place, the last one reaches furthest.
    known = [[s for s in base if s.kind == kind] for kind in range(len(KINDS))]
    for start, kind, end in detect(plain.out):
        low, high, changed = plain.source(start, end)
        # A rewritten character, or one that was left out, is a disguise.
        if changed or high - low > end - start:
            k = bisect_right(known[kind], low, key=lambda s: s.start)
            if not k or known[kind][k - 1].end < high:
                added.append(Span(low, kind, high))
    return base, sorted(added)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_email, n_ip, n_card and n_phone (base spans), n_added, base_sha256, spans."""
    kind = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "added")], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(len(KINDS) + 1)]
            digests, spans = [], []
            for value in batch.column(len(keep)):
                base, added = find_spans(value.as_py() or "")
                for k in range(len(KINDS)):
                    counts[k].append(sum(s.kind == k for s in base))
                counts[-1].append(len(added))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + added)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=kind.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).mapInArrow(find, kind)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``length`` follows the new text.  Null text stays null."""
    at, sized = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else -1

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        base, added = find_spans(value)
        spans, out, done = sorted(base + added), [], 0
        for s in spans:
            if s.start >= done:
                out += [value[done : s.start], f"[{KINDS[s.kind].upper()}]"]
            done = max(done, s.end)
        return "".join([*out, value[done:]]) if spans else value

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(v.as_py()) for v in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if sized >= 0:
                columns[sized] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[sized].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(cleaned, docs.schema)
