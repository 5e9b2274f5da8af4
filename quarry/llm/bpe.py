"""Vectorised word splitting and word-level BPE, shared by operators 3, 7 and 9.

A byte-level BPE with the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

encodes each matched word alone, so a text's ids are its words' ids in order.
``WordSplitter`` finds the words of many texts in a few NumPy passes over their
code points; the caller resolves each *distinct* word of a batch once. Whether
a code point is a letter, number, white space or other is asked of the
tokenizers library itself the first time it is met, so both always agree.

``safe_cut``: a change from non-space to white space is a word boundary in
every text around it, because no alternative of the pattern continues from a
non-space character into white space. Long texts are cut there, so memory
stays bounded by ``SLICE_CHARS`` plus the longest run without white space.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points encoded at once: bounds the memory of a worker, not the texts.
SLICE_CHARS = 4_000_000
#: Distinct words a worker remembers; later ones are encoded each time.
CACHE_WORDS = 200_000

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
_SAFE = re.compile(r"(?<=[!-~])[ \n\t]")


def byte_letters() -> dict[int, int]:
    """Byte -> code point by which byte-level vocabularies write it: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


def check_supported(path: str) -> dict:
    """The tokenizer file as a dict; raises when it is not a plain byte-level
    BPE (the only kind whose words can be encoded one by one as done here)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if not (spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
            and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
            and not model.get("ignore_merges")):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens with options are not supported")
    return spec


class WordSplitter:
    """Splits texts into the tokenizer's words; one instance per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        spec = check_supported(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self._class = np.full(0x110000, UNKNOWN, np.uint8)

    def _learn(self, points: np.ndarray) -> None:
        pre = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            ch = chr(p)
            self._class[p] = next((c for c, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))
                                   if len(pre(lead + ch)) == 1), SPACE)

    def classes(self, points: np.ndarray) -> np.ndarray:
        c = self._class[points]
        if (c == UNKNOWN).any():
            self._learn(np.unique(points[c == UNKNOWN]))
            c = self._class[points]
        return c

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Words of ``texts`` in order (Arrow binary array over one shared
        buffer), the number of words of each text, and for every word the
        index of its first code point in the joined texts and its class flag
        (True: the word begins right after a non-space and is white space,
        hence a safe cut)."""
        segments, owner, special = [], [], []
        for i, t in enumerate(texts):
            pieces = self._added.split(t) if self._added is not None else [t]
            for k, piece in enumerate(pieces):
                if piece:
                    segments.append(piece)
                    owner.append(i)
                    special.append(k % 2 == 1)
        joined = "".join(segments)
        data = joined.encode()
        if not data:
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(point)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        first = np.cumsum(lengths) - lengths
        start = np.zeros(n + 2, bool)
        start[first] = start[n] = True
        cls = self.classes(point)
        space = cls == SPACE
        bound = np.empty(n + 2, bool)
        bound[0] = bound[n] = bound[n + 1] = True
        np.not_equal(cls[1:], cls[:-1], out=bound[1:n])
        # last white space before a word of the same text
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~start[1:n])
        bound[last] = True
        bound[last + 1] = point[last] != 32
        bound[:n] |= start[:n]
        mark = np.flatnonzero((point == 39) & bound[:n])
        if len(mark):
            padded = np.zeros(n + 3, np.uint32)
            padded[:n] = point
            a, b = padded[mark + 1], padded[mark + 2]
            ok1 = ~start[mark + 1]
            one = ok1 & np.isin(a, [ord(x) for x in "stmd"])
            two = ok1 & ~start[mark + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))
                                            | (a == ord("l")) & (b == ord("l")))
            bound[mark[one | two] + 1] = False
            bound[mark[one] + 2] = True
            bound[mark[two] + 2] = False
            bound[mark[two] + 3 - (mark[two] + 3 > n)] = True
        for k in np.flatnonzero(special):
            bound[first[k] + 1:first[k] + lengths[k]] = False
        at = np.flatnonzero(bound[:n])
        if len(data) == n:
            offsets = np.append(at, n)
        else:
            width = 1 + (point >= 0x80).astype(np.int8) + (point >= 0x800) + (point >= 0x10000)
            before = np.cumsum(width, dtype=np.int64) - width
            offsets = np.append(before[at], len(data))
        words = pa.Array.from_buffers(pa.binary(), len(at), [
            None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        seg_end = np.searchsorted(at, first + lengths)
        per_segment = np.diff(np.concatenate([[0], seg_end]))
        counts = np.bincount(owner, weights=per_segment, minlength=len(texts)).astype(np.int64)
        safe = np.zeros(len(at), bool)
        later = at > 0
        safe[later] = space[at[later]] & ~space[at[later] - 1]
        return words, counts, at, safe


def pieces(text: str, limit: int | None = None) -> list[str]:
    """``text`` cut at safe boundaries into parts of about ``limit``."""
    limit, out, i = limit or SLICE_CHARS, [], 0
    while len(text) - i > limit:
        m = _SAFE.search(text, i + limit)
        if m is None:
            break
        out.append(text[i:m.start()])
        i = m.start()
    out.append(text[i:] if i else text)
    return out


def slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of ``texts`` (null: empty) with the row each belongs to, grouped
    to about SLICE_CHARS; the parts of a row come in order."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for p in pieces(t or ""):
            rows.append(i)
            parts.append(p)
            size += len(p)
            if size >= SLICE_CHARS or len(rows) >= 20_000:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[s:s+n]`` for each (s, n), joined."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[np.arange(total) + shift]


class LibraryWords:
    """Ids of distinct words from the tokenizers library's own model; the
    first CACHE_WORDS words a worker meets are remembered."""

    def __init__(self, splitter: WordSplitter):
        self._model, self._letters = splitter.tokenizer.model, byte_letters()
        self._known = pa.array(list(splitter.added), pa.binary())
        self._ids = np.array(list(splitter.added.values()), np.uint32)
        self._count = np.ones(len(splitter.added), np.int64)

    def resolve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids per word)."""
        at = pc.index_in(words, value_set=self._known)
        unseen = pc.is_null(at)
        at = at.fill_null(-1).to_numpy().copy()
        tokenize, letters = self._model.tokenize, self._letters
        new = [[t.id for t in tokenize(w.decode("latin-1").translate(letters))]
               for w in words.filter(unseen).to_pylist()]
        size = np.fromiter(map(len, new), np.int64, len(new))
        got = np.fromiter(chain.from_iterable(new), np.uint32, int(size.sum()))
        ids, per = np.concatenate([self._ids, got]), np.concatenate([self._count, size])
        miss = at < 0
        at[miss] = len(self._count) + np.arange(len(new))
        room = max(0, CACHE_WORDS - len(self._known))
        if new and room:
            kept = words.filter(unseen)[:room]
            self._known = pa.concat_arrays([self._known, kept])
            self._ids = ids[:len(self._ids) + int(size[:room].sum())]
            self._count = per[:len(self._known)]
        start = np.cumsum(per) - per
        return ragged(ids, start[at], per[at]), per[at]


class Encoder:
    """Whole texts to ids, by splitting and resolving distinct words."""

    def __init__(self, splitter: WordSplitter, words):
        self.splitter, self.words = splitter, words

    def _resolved(self, words: pa.Array):
        enc = words.dictionary_encode()
        flat, per = self.words.resolve(enc.dictionary)
        return enc.indices.to_numpy(zero_copy_only=False), flat, per

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        for rows, parts in slices(texts):
            words, n_words, _, _ = self.splitter.split(parts)
            idx, _, per = self._resolved(words)
            total = np.concatenate([[0], np.cumsum(per[idx])])
            ends = np.cumsum(n_words)
            np.add.at(out, rows, total[ends] - total[ends - n_words])
        return out

    def ids(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """For each slice: rows, ids joined (uint32), ids per part."""
        for rows, parts in slices(texts):
            words, n_words, _, _ = self.splitter.split(parts)
            idx, flat, per = self._resolved(words)
            n = per[idx]
            total = np.concatenate([[0], np.cumsum(n)])
            ends = np.cumsum(n_words)
            start = np.cumsum(per) - per
            yield rows, ragged(flat, start[idx], n), total[ends] - total[ends - n_words]


@lru_cache(maxsize=4)
def library_encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    splitter = WordSplitter(path)
    return Encoder(splitter, LibraryWords(splitter))
