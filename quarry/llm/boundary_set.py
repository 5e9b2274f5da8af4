"""A compressed set of offsets with select, for operator 13.

Offsets are dealt by their high 16 bits to containers of one of three kinds, the
smallest of them: a sorted array, a bitmap of 65,536 bits, or runs (start, length).
Containers keep cumulative cardinalities: ``select`` finds the container of a rank
by binary search and then selects inside it.
"""

from __future__ import annotations

import numpy as np

BITMAP_BYTES = 8192


class ArrayOffsets:
    """Sorted low halves."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class BitmapOffsets:
    """One bit an offset; cumulative counts of its 1,024 words."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(65536, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, rank: int) -> int:
        word = int(np.searchsorted(self.upto, rank, side="right"))
        rank -= int(self.upto[word - 1]) if word else 0
        bits = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[rank])


class RunOffsets:
    """Runs of consecutive offsets: starts and cumulative lengths."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.upto = starts.astype(np.uint16), np.cumsum(lengths)

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.upto, rank, side="right"))
        return int(self.starts[run]) + rank - (int(self.upto[run - 1]) if run else 0)


def container(low: np.ndarray) -> ArrayOffsets | BitmapOffsets | RunOffsets:
    """The smallest container for sorted distinct numbers below 65,536."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(first) < min(2 * len(low), BITMAP_BYTES):
        return RunOffsets(low[first], np.diff(first, append=len(low)))
    return ArrayOffsets(low) if 2 * len(low) <= BITMAP_BYTES else BitmapOffsets(low)


class BoundarySet:
    """A set of offsets made from sorted distinct non-negative integers."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        if len(high) and high[0] == high[-1]:
            first = np.zeros(1, np.int64)
        else:
            first = np.flatnonzero(np.diff(high, prepend=-1) != 0)
        self.high = high[first]
        cuts = [*first.tolist(), len(offsets)]
        self.containers = [container(offsets[a:b] & 0xFFFF) for a, b in zip(cuts, cuts[1:])]
        self.upto = np.array(cuts[1:], np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, rank: int) -> int:
        """The ``rank``-th smallest offset, from 0."""
        k = int(np.searchsorted(self.upto, rank, side="right"))
        before = int(self.upto[k - 1]) if k else 0
        return (int(self.high[k]) << 16) | self.containers[k].select(rank - before)
