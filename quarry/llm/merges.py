"""Exact BPE merging of many words at once (NumPy), used by operator 9.

Words of one length form a matrix of symbol ids. One pass merges, in every row
that still has a mergeable pair, its pair of lowest rank (leftmost on ties), so
each such row loses exactly one column and the matrix stays rectangular. Rows
without a mergeable pair are finished. This is the merge order of the BPE
definition; nothing is approximated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .bpe import byte_letters, ragged

#: Words longer than this are merged alone, by a heap, in n log n steps.
LONG_WORD = 96
_NONE = np.int32(2**31 - 1)


class MergeWords:
    """Resolves distinct words to ids by a vocabulary file's merge list."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.byte_id = np.array([vocab[chr(letters[b])] for b in range(256)], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._shift = max(vocab.values()) + 1
        # open addressing, at most a quarter full; a pair listed twice keeps its lowest rank
        self._bits = int(np.ceil(np.log2(max(4 * len(merges), 16))))
        self._key = np.full(1 << self._bits, -1, np.int64)
        self._rank = np.full(1 << self._bits, _NONE, np.int32)
        self._made = np.zeros(1 << self._bits, np.int32)
        mask = (1 << self._bits) - 1
        for rank, (k, m) in enumerate(zip((left * self._shift + right).tolist(), made.tolist())):
            at = self._slot_of(k)
            while self._key[at] not in (-1, k):
                at = (at + 1) & mask
            if self._key[at] == -1:
                self._key[at], self._rank[at], self._made[at] = k, rank, m

    def _slot_of(self, k: int) -> int:
        return ((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self._bits)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Table slot of each pair, or -1."""
        key = a.astype(np.int64) * self._shift + b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)
        got = self._key[at]
        out = np.where(got == key, at, -1)
        todo = np.flatnonzero((got != key) & (got != -1))
        mask = (1 << self._bits) - 1
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            got = self._key[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (got != -1)]
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self._find(a.ravel(), b.ravel())
        return np.where(at >= 0, self._rank[at], _NONE).reshape(a.shape)

    def _long(self, word: bytes) -> list[int]:
        import heapq
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prev = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < len(ids):
                at = self._slot_of(k := ids[i] * self._shift + ids[j])
                while self._key[at] not in (-1, k):
                    at = (at + 1) & ((1 << self._bits) - 1)
                if self._key[at] == k:
                    heapq.heappush(heap, (int(self._rank[at]), i, ids[i], ids[j], int(self._made[at])))

        for i in range(len(ids)):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = made, -1, nxt[j]
            if nxt[i] < len(ids):
                prev[nxt[i]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return [x for x in ids if x >= 0]

    def _block(self, sym: np.ndarray, where: np.ndarray, out: list) -> None:
        rank = self._ranks(sym[:, :-1], sym[:, 1:]) if sym.shape[1] > 1 else None
        while sym.shape[1] > 1:
            j = rank.argmin(axis=1)
            row = np.arange(len(sym))
            done = rank[row, j] == _NONE
            if done.any():
                out.append((where[done], sym[done]))
                keep = ~done
                sym, rank, where, j = sym[keep], rank[keep], where[keep], j[keep]
                row = np.arange(len(sym))
            if not len(sym):
                return
            width = sym.shape[1]
            sym[row, j] = self._made[self._find(sym[row, j], sym[row, j + 1])]
            left = np.ones(sym.shape, bool)
            left[row, j + 1] = False
            sym = sym[left].reshape(len(row), width - 1)
            left = np.ones(rank.shape, bool)
            left[row, j] = False
            rank = rank[left].reshape(len(row), width - 2)
            if width > 2:
                r = np.flatnonzero(j > 0)
                rank[r, j[r] - 1] = self._ranks(sym[r, j[r] - 1], sym[r, j[r]])
                r = np.flatnonzero(j < width - 2)
                rank[r, j[r]] = self._ranks(sym[r, j[r]], sym[r, j[r] + 1])
        out.append((where, sym))

    def resolve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids per word) of a binary array."""
        data, offsets = binary_buffers(words)
        length = np.diff(offsets)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        special = np.zeros(len(length), bool)
        for content, i in self.added.items():
            for k in np.flatnonzero(length == len(content)):
                if data[offsets[k]:offsets[k + 1]].tobytes() == content:
                    special[k] = True
                    parts.append((np.array([k]), np.array([[i]])))
        for n in np.unique(length[~special]).tolist():
            at = np.flatnonzero((length == n) & ~special)
            if n > LONG_WORD:
                for k in at:
                    ids = self._long(data[offsets[k]:offsets[k + 1]].tobytes())
                    parts.append((np.array([k]), np.array([ids])))
            elif n:
                for lo in range(0, len(at), 1 << 16):
                    k = at[lo:lo + (1 << 16)]
                    sym = self.byte_id[data[offsets[k][:, None] + np.arange(n)]].astype(np.int32)
                    self._block(sym, k, parts)
        counts = np.zeros(len(length), np.int64)
        start = np.zeros(len(length), np.int64)
        pos = 0
        for k, m in parts:
            counts[k] = m.shape[1]
            start[k] = pos + np.arange(len(k)) * m.shape[1]
            pos += m.size
        flat = np.concatenate([m.ravel() for _, m in parts]) if parts else np.zeros(0, np.int64)
        return ragged(flat.astype(np.uint32), start, counts), counts


def binary_buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array without nulls."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = words.buffers()
    offsets = np.frombuffer(off, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets
