"""Memory of Python workers.

Spark keeps its workers from stage to stage, so that what a task's arrays leave behind in the allocators
counts as memory of all stages after it.  The tasks of the n-gram join and the codec, whose arrays are the largest, hand it back when they end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa


@lru_cache(maxsize=1)
def _trim_heap() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives free memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    heap = _trim_heap()
    if heap is not None:
        heap(0)


def trimmed(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that trims when it ends."""

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            trim()

    return run
