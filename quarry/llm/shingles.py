"""Vectorised word shingles and PartEnum signatures (operator 8)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, first word of each text and the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    gap = _GAP[data]
    before = np.concatenate([[True], gap[:-1]])
    first = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(gap & ~before)
    size = 1 << int(len(data)).bit_length()
    up, down = _powers(max(size, 1 << 21))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:len(data)])])
    words = mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(first, starts)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, joined; set sizes)."""
    words, at = word_hashes(texts)
    n = len(words)
    run = np.zeros(max(n, 1), np.uint64)[:n]
    for j in range(width):
        if n > j:
            run[:n - j] += words[j:] * _PLACE[j]
    run = mix(run)
    sets = []
    for i in range(len(texts)):
        lo, hi = int(at[i]), int(at[i + 1])
        if hi - lo >= width:
            sets.append(np.unique(run[lo:hi - width + 1]))
        elif hi > lo:
            short = np.array([hi - lo], np.uint64)
            for j in range(hi - lo):
                short = short * _PLACE[-1] + words[lo + j:lo + j + 1] * _PLACE[j]
            sets.append(mix(short))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def set_hashes(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, independent of order."""
    end = np.cumsum(sizes)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ _U(salt)))])
        out.append(mix(total[end] - total[end - sizes] + sizes.astype(np.uint64)))
    return out[0], out[1]


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of a set's sketch: a power of two, its size or more, at least 256."""
    return np.maximum(256, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def parity_sketches(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parities per set: bit b tells whether an odd number of elements falls on
    b, so two sets differ in at least as many elements as bits. Halves of a
    sketch XORed give the sketch of half the bits."""
    bits = sketch_bits(sizes)
    end = np.cumsum(bits)
    cell = np.repeat(end - bits, sizes) + (flat & (np.repeat(bits, sizes).astype(np.uint64) - _U(1))).astype(np.int64)
    odd = (np.bincount(cell, minlength=int(end[-1]) if len(end) else 0) & 1).astype(np.uint8)
    packed = np.packbits(odd).tobytes()
    return [packed[(e - k) // 8:e // 8] for e, k in zip(end.tolist(), bits.tolist())]


class Sketches:
    """Sketches of different lengths, compared by pairs of rows."""

    def __init__(self, sketches: list[bytes]):
        size = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.level = np.log2(np.maximum(size, 32) // 32).astype(np.int64)
        self.at = np.zeros(len(size), np.int64)
        self.full, self.half = {}, {}
        for k in np.unique(self.level).tolist():
            rows = np.flatnonzero(self.level == k)
            self.at[rows] = np.arange(len(rows))
            m = np.frombuffer(b"".join(sketches[r] for r in rows), np.uint64).reshape(len(rows), -1)
            self.full[k], self.half[k] = m, m[:, :m.shape[1] // 2] ^ m[:, m.shape[1] // 2:]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits by which rows i and j differ, a lower bound of their sets'
        difference; rows of sizes within 3/4 have levels one apart at most."""
        out = np.zeros(len(i), np.int64)
        li, lj = self.level[i], self.level[j]
        for k in self.full:
            for other in (k - 1, k, k + 1):
                p = np.flatnonzero((li == k) & (lj == other))
                if len(p):
                    a = (self.half if other < k else self.full)[k][self.at[i[p]]]
                    b = (self.half if other > k else self.full)[other][self.at[j[p]]]
                    out[p] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return out


def signatures(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sorted sets: (signature, set it belongs to).

    Two sets r, s with Jaccard >= 3/4 differ in d <= (|r|+|s|)/7 elements. The
    feature domain is halved over and over by the elements' leading bits. If
    d <= S/7 holds for a part with S > 0 elements of both, it holds for one of
    its halves with elements. A part with S <= 13 has d <= 1: of its two halves
    one is equal in both sets. So wherever a part has at most 7 elements of r
    (S <= 13 allows no more), r gives the content of each of its halves as a
    signature, and parts of 6 or more are halved further (S may be 14). Where all
    elements fall into one half, that half's content is a signature and halving
    goes on until they separate, since the other set's one element more may
    separate before. A signature is a hash of the half's content and nothing
    else. Parts whose parent has fewer than 6 elements are not reached: there
    S <= 13 already held.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    salted = mix(flat ^ _U(0x8CB92BA72F3D8DD7))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted)])
    end = np.cumsum(sizes)
    lo, hi = (end - sizes)[sizes > 0], end[sizes > 0]
    sig, own = [], []

    def give(a: np.ndarray, b: np.ndarray) -> None:
        ok = b > a
        a, b = a[ok], b[ok]
        sig.append(mix(total[b] - total[a] + (b - a).astype(np.uint64)))
        own.append(owner[a])

    # lo, hi: parts as ranges of the sorted elements; wide: still to be halved as parts
    wide = np.ones(len(lo), bool)
    for depth in range(64):
        if not len(lo):
            break
        bit = _U(63 - depth)
        # first element of the part with the bit set: parts share their leading bits
        one = (flat >> bit) & _U(1)
        ones = np.concatenate([[0], np.cumsum(one.astype(np.int64))])
        mid = hi - (ones[hi] - ones[lo])
        m = hi - lo
        small = m <= 7
        give(lo[small], mid[small])
        give(mid[small], hi[small])
        whole = (mid == lo) | (mid == hi)
        # a small part that did not separate stays; a part of 6 or more goes on as two parts
        stay = small & whole & (m > 1) & ((m < 6) | ~wide)
        split = wide & (m >= 6)
        left, right = split & (mid > lo), split & (hi > mid)
        lo, hi, wide = (np.concatenate([lo[stay], lo[left], mid[right]]), np.concatenate([hi[stay], mid[left], hi[right]]),
                        np.concatenate([np.zeros(int(stay.sum()), bool), np.ones(int(left.sum() + right.sum()), bool)]))
    if not sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sig, own = np.concatenate(sig), np.concatenate(own)
    # the same content may be met at several depths
    order = np.lexsort((sig, own))
    sig, own = sig[order], own[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
    return sig[new], own[new]
