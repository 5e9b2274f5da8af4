"""Texts of Arrow batches in slices of bounded size, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000


def binary_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows (first row, UTF-8 texts; null: empty) of about ``size`` bytes, one
    whole text at least. Only the slice in work is turned into Python objects."""
    if not len(column):
        return
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, [t or b"" for t in raw.slice(lo, hi - lo).to_pylist()]
        lo = hi


def give_back() -> None:
    """Returns what Arrow and the C library hold for reuse: a Python worker outlives
    its task and waits for the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slim(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory back when its task ends."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return task
