"""Minimal acyclic transducer over frequent words (operator 9).

``compile_words`` builds the smallest deterministic automaton of a sorted word
list: common prefixes share their path and equal suffix languages share their
states (states are registered by content as soon as no later word can change
them). Every transition carries the number of words that sort before its
branch; the sum along a word's path is the word's number, by which its token
ids are found. ``Transducer`` maps the written arrays and follows many words at
once, one array step per byte.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .bpe import ragged
from .merges import MergeWords, binary_buffers


def compile_words(words: list[bytes], flat: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the transducer for strictly ascending non-empty ``words``
    whose ids are ``flat``, ``counts`` per word."""
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}

    def settle(path: list[tuple[int, int]], keep: int) -> None:
        while len(path) > keep:
            parent, byte = path.pop()
            child = edges[parent][byte]
            same = register.setdefault((final[child], tuple(edges[child].items())), child)
            edges[parent][byte] = same

    path: list[tuple[int, int]] = []
    previous = b""
    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        settle(path, common)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        previous = word
    settle(path, 0)
    # number the states that are still reachable; children before parents
    order, seen, stack = [], {0}, [(0, iter(edges[0].values()))]
    while stack:
        state, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            order.append(state)
            stack.pop()
        elif child not in seen:
            seen.add(child)
            stack.append((child, iter(edges[child].values())))
    number = {s: i for i, s in enumerate(reversed(order))}
    below: dict[int, int] = {}
    key, target, output = [], [], []
    for state in order:
        total = int(final[state])
        for byte, child in edges[state].items():   # ascending: words came sorted
            key.append(number[state] << 8 | byte)
            target.append(number[child])
            output.append(total)
            total += below[child]
        below[state] = total
    by = np.argsort(np.array(key, np.int64), kind="stable")
    ends = np.zeros(len(order), np.uint8)
    ends[[number[s] for s in order]] = [final[s] for s in order]
    return {"key": np.array(key, np.int64)[by], "target": np.array(target, np.int32)[by],
            "output": np.array(output, np.int32)[by], "final": ends,
            "start": np.cumsum(np.concatenate([[0], counts])).astype(np.int64), "ids": flat.astype(np.uint32)}


def write_transducer(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: a line of JSON (name, type, items, place), then the arrays."""
    head, at = [], 0
    for name, a in arrays.items():
        head.append([name, a.dtype.str, len(a), at])
        at += -(-a.nbytes // 8) * 8
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    with open(path, "wb") as f:
        f.write(line)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


class Transducer:
    """A written transducer, memory-mapped; words it lacks are merged."""

    def __init__(self, path: str, merges: MergeWords):
        with open(path, "rb") as f:
            line = f.readline()
        whole = np.memmap(path, np.uint8, "r")
        for name, kind, n, at in json.loads(line):
            lo = len(line) + at
            setattr(self, name, whole[lo:lo + n * np.dtype(kind).itemsize].view(kind))
        self.merges = merges

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Number of each word, or -1."""
        data, offsets = binary_buffers(words)
        length = np.diff(offsets)
        out = np.full(len(length), -1, np.int64)
        if not len(self.key):
            return out
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            state = np.zeros(len(at), np.int64)
            total = np.zeros(len(at), np.int64)
            for p in range(n):
                key = state << 8 | data[offsets[at] + p]
                i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                ok = self.key[i] == key
                if not ok.all():
                    at, i, total = at[ok], i[ok], total[ok]
                if not len(at):
                    break
                state = self.target[i].astype(np.int64)
                total = total + self.output[i]
            if len(at):
                end = self.final[state].astype(bool)
                out[at[end]] = total[end]
        return out

    def resolve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids per word)."""
        no = self.numbers(words)
        new = no < 0
        got, size = self.merges.resolve(words.filter(pa.array(new)))
        have = no[~new]
        start, count = np.zeros(len(no), np.int64), np.zeros(len(no), np.int64)
        start[~new], count[~new] = self.start[have], self.start[have + 1] - self.start[have]
        start[new], count[new] = len(self.ids) + np.cumsum(size) - size, size
        return ragged(np.concatenate([self.ids, got]), start, count), count
