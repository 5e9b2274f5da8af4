"""Operator 7: token counts by overlap resynchronisation.

Texts of up to ``chunk_chars`` characters are encoded as they are. A longer
text becomes windows: chunk k covers ``[k*c, (k+1)*c)`` and its window reaches
``overlap`` characters further on both sides. Windows are dealt over the
cluster, encoded with offsets, and each reports the first proven boundary in
the overlap it shares with either neighbour: a token start where white space
follows a non-space character, which is a word boundary whatever stands around
it (see ``bpe``). Neighbours are spliced only when both report the same
position; a text with an overlap that holds no such boundary is encoded again
with an overlap 16 times as wide, up to one window over the whole text. Counts
are therefore exact, and equal the library's over the whole text.

Defined results: null text counts as empty (0 bytes, 0 tokens); null ids and
repeated rows are kept, one row out per row in; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import check_supported, library_encoder, slices

CHUNK_CHARS = 32_768
OVERLAP = 256
WIDEN = 16
_GROUP = 64   # windows encoded together


@lru_cache(maxsize=4)
def _whole_text_counter(path: str):
    """Counter for tokenizers whose words cannot be encoded one by one."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(model.encode(t or "", num_threads=1)) for t in texts], np.int64)
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: np.array([len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts], np.int64)


def splittable(path: str) -> bool:
    """Whether the tokenizer is a byte-level BPE, whose boundaries are proven."""
    if not path.endswith(".json"):
        return False
    try:
        check_supported(path)
    except (ValueError, KeyError):
        return False
    return True


def _count_whole(path: str, fast: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = library_encoder(path).counts if fast else _whole_text_counter(path)
        for b in batches:
            n = count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                ["row", "doc_id", "n_bytes", "n_tokens"])
    return run


def _windows(chunk: int, overlap: int):
    """Rows (row, doc_id, n_bytes, text) to windows, one linear pass a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, size, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "n_bytes", "text"))):
                n = 1 if overlap >= len(text) else -(-len(text) // chunk)
                for lo in range(0, n, _GROUP):
                    ks = range(lo, min(lo + _GROUP, n))
                    begin = [max(0, k * chunk - overlap) if k else 0 for k in ks]
                    end = [len(text) if k == n - 1 else (k + 1) * chunk + overlap for k in ks]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(ks), pa.int64()), pa.array([doc] * len(ks), b.schema.field("doc_id").type),
                         pa.array([size] * len(ks), pa.int64()), pa.array(ks, pa.int64()),
                         pa.array([k == n - 1 for k in ks]), pa.array(begin, pa.int64()),
                         pa.array([text[i:j] for i, j in zip(begin, end)], pa.string())],
                        ["row", "doc_id", "n_bytes", "k", "last", "base", "text"])
    return run


def _first_in(points: np.ndarray, lo: int, hi: int) -> int | None:
    i = int(np.searchsorted(points, lo, "right"))
    return int(points[i]) if i < len(points) and points[i] < hi else None


def _encode_windows(path: str, chunk: int, overlap: int):
    """Each window's cuts (absolute positions) and the tokens between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(path)
        for b in batches:
            k, last, base = (b.column(c).to_pylist() for c in ("k", "last", "base"))
            texts = b.column("text").to_pylist()
            left, right, total = [], [], []
            for lo in range(0, len(texts), _GROUP):
                part = texts[lo:lo + _GROUP]
                words, n_words, at, safe = enc.splitter.split(part)
                idx, _, per = enc._resolved(words)
                before = np.concatenate([[0], np.cumsum(per[idx])])
                ends, char = np.cumsum(n_words), 0
                for i, text in enumerate(part):
                    w0, w1, j = int(ends[i] - n_words[i]), int(ends[i]), lo + i
                    pos = at[w0:w1] - char + base[j]
                    cuts = pos[safe[w0:w1]]
                    a = 0 if k[j] == 0 else _first_in(cuts, k[j] * chunk - overlap, k[j] * chunk + overlap)
                    z = None if last[j] else _first_in(cuts, (k[j] + 1) * chunk - overlap, (k[j] + 1) * chunk + overlap)
                    known = a is not None and (last[j] or z is not None)
                    if known:
                        i0 = w0 + int(np.searchsorted(pos, a))
                        i1 = w1 if last[j] else w0 + int(np.searchsorted(pos, z))
                    left.append(a)
                    right.append(z)
                    total.append(int(before[i1] - before[i0]) if known and i1 >= i0 else None)
                    char += len(text)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("n_bytes"), b.column("k"), b.column("last"),
                 pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(total, pa.int64())],
                ["row", "doc_id", "n_bytes", "k", "last", "cut", "next_cut", "n"])
    return run


def _spliced(long_docs: DataFrame, path: str, id_type: str, chunk: int, overlap: int) -> DataFrame:
    """One row per long text; n_tokens is null where a splice failed."""
    windows = long_docs.mapInArrow(
        _windows(chunk, overlap), f"row long, doc_id {id_type}, n_bytes long, k long, last boolean, base long, text string")
    parts = windows.repartition("row", "k").mapInArrow(
        _encode_windows(path, chunk, overlap),
        f"row long, doc_id {id_type}, n_bytes long, k long, last boolean, cut long, next_cut long, n long")
    following = F.lead("cut").over(Window.partitionBy("row").orderBy("k"))
    parts = parts.withColumn("fits", F.col("n").isNotNull() & (F.col("last") | (F.col("next_cut") == following)))
    return parts.groupBy("row", "doc_id", "n_bytes").agg(
        F.when(F.bool_and(F.coalesce("fits", F.lit(False))), F.sum("n")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "n_bytes": F.octet_length("text").cast("long")})
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = f"row long, doc_id {id_type}, n_bytes long, n_tokens long"
    fast = splittable(path)
    is_long = F.length("text") > chunk_chars
    counted = (rows.where(~is_long) if fast else rows).mapInArrow(_count_whole(path, fast), out)
    if fast:
        long_docs = todo = rows.where(is_long)
        while True:
            done = materialize(_spliced(todo, path, id_type, chunk_chars, overlap), "spliced")
            counted = counted.unionByName(done.where("n_tokens is not null"))
            failed = done.where("n_tokens is null").select("row")
            if failed.isEmpty():
                break
            todo = long_docs.join(failed, "row", "left_semi")
            overlap *= WIDEN
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
