"""Vectorised word and shingle hashing over the bytes of an Arrow string column.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; A-Z count as a-z.  Both rules
look at ASCII bytes only, so they can be applied to UTF-8 directly.  Words get 64-bit
polynomial hashes from prefix sums, so that no Python object is made for a word.

Hashes stand for words and shingles throughout: two different shingles share one with a
probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; bounds memory however long a text is.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if n > len(_powers.known[0]):
        size = max(PIECE + 1, 2 * n)
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.known[at] = np.multiply.accumulate(steps)
    return _powers.known[0][:n], _powers.known[1][:n]


_powers.known = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


#: Everything but ASCII letters, digits and bytes of other characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _hash_words(data: np.ndarray, first: np.ndarray, gaps: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``data``; ``first`` marks bytes where a new text begins."""
    inside = ~gaps[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power, out=sums[1:])
    if prefix:
        stops = np.minimum(stops, starts + prefix)
    return starts, mix((sums[stops] - sums[starts]) * inverse[starts])


def hash_texts(texts: pa.Array, gaps: np.ndarray = _SPACE, prefix: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word hashes of consecutive texts: (index of the first text, words before each text, hashes).

    Text ``i`` of a piece has the words ``hashes[before[i]:before[i + 1]]``.  A null text has none.
    ``gaps`` are the bytes between words; ``prefix`` hashes so many bytes of each word only.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, "right")) - 1)
        low, high = int(bounds[at]), int(bounds[upto])
        if high - low > PIECE:
            yield at, *_long_text(data[low:high], gaps, prefix)
        else:
            first = np.zeros(high - low + 1, bool)
            first[bounds[at:upto] - low] = True
            starts, hashes = _hash_words(data[low:high], first[:-1], gaps, prefix)
            yield at, np.searchsorted(starts, bounds[at : upto + 1] - low), hashes
        at = upto


def _long_text(data: np.ndarray, gaps: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """One text of more than ``PIECE`` bytes, hashed from one gap to another."""
    found, at = [], 0
    while at < len(data):
        upto = at + PIECE
        while upto < len(data):
            between = np.flatnonzero(gaps[data[at:upto]])
            if len(between):
                upto = at + int(between[-1]) + 1
                break
            upto += PIECE
        piece = data[at : min(upto, len(data))]
        found.append(_hash_words(piece, np.zeros(len(piece), bool), gaps, prefix)[1])
        at = upto
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return np.array([0, len(hashes)]), hashes


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Running hashes of all runs of ``size`` words in order, from prefix sums, so that any width takes one pass; of fewer words, one of the whole sequence."""
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    power, inverse = _powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power, out=sums[1:])
    return mix((sums[width:] - sums[:n]) * inverse[:n] + np.uint64(width))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))] if len(values) else values
