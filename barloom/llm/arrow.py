"""Small helpers of the operators that run Python inside Arrow tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Objects that a worker process keeps between tasks.
KEPT_OBJECTS = 12


def worker_cache(key: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, kept between tasks.

    Functions are shipped to the workers by value, so their module globals are new in each task;
    the cache hangs on a module entry of the process instead.  It holds ``KEPT_OBJECTS``; the one that
    was not asked for the longest goes.
    """
    home = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    held = home.__dict__.setdefault("held", {})
    value = held.pop(key) if key in held else make()
    held[key] = value
    while len(held) > KEPT_OBJECTS:
        del held[next(iter(held))]
    return value


class ByteCache:
    """Small results by small keys in about ``limit`` bytes at most: what was not asked for while half of them filled goes.

    ``young`` may be read directly; what it lacks may still be found by ``get``.
    """

    ENTRY = 200  # of two objects of some tens of bytes and their place in a table

    def __init__(self, limit: int):
        self.half, self.young, self.old, self.size = limit // 2, {}, {}, 0

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self.size += self.ENTRY
        self.young[key] = value
        if self.size > self.half:
            self.young, self.old, self.size = {}, self.young, 0


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; a null is an empty text."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def groups(texts: list[bytes], budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``budget`` bytes; a longer text is a range of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > budget:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def segment_ids(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``budget`` bytes of ``column``, so that memory follows the budget
    and the longest text, not the number of rows that Spark puts in a batch."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        first = 0
        while first < len(sizes):
            running = np.cumsum(sizes[first:first + 4096])
            n = max(1, int(np.searchsorted(running, budget)))
            yield batch.slice(first, n)
            first += n
