"""T10 over passage rows: greedy chunk packing without gathering a document.

Packing closes a chunk at the first passage that brings the running count
(``length + 2`` per passage) to ``min_chars``, then starts again. A document is cut
into blocks of ``block`` order values, one row each (one exchange); inside a block
the packing is the native fold and slices of ``passages.pack_chunks``.

The only thing that crosses blocks is the count left open, so a block is a function
of its entry count: ``limits[j]`` is the count up to passage j, the chunk open at
entry closes at the first j with ``entry + limits[j] >= min_chars``, and what is left
open at the end (``carry``) and closed after it (``closed``) depend on j alone. Such
functions compose to one of the same kind. Only documents of several blocks need
them: they are composed over ``SPAN`` blocks, then over a document's spans, and
handed back down, so no group is larger than ``SPAN`` short summaries or a document's
number of spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .passages import CHUNK_MIN_CHARS, CHUNK_SEPARATOR_CHARS, chunk_ends, chunk_slices

DEFAULT_BLOCK = 1024
SPAN = 1024

# (limits, carry, closed, total) of a block or a run of blocks
Summary = tuple[list[int], list[int], list[int], int]


def summary_of(weights: np.ndarray, min_chars: int) -> Summary:
    """The function of one block of passages."""
    upto = np.concatenate([[0], np.cumsum(weights)])
    n = len(weights)
    # where a chunk that starts at s closes: the next one starts there
    following = np.searchsorted(upto, upto[:-1] + min_chars, side="left")
    carry, closed = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for s in range(n - 1, -1, -1):
        e = int(following[s])
        carry[s], closed[s] = (upto[n] - upto[s], 0) if e > n else (carry[e], closed[e] + 1)
    # entry 0 closes at the first limit of min_chars, others before it
    heads = min(n, int(np.searchsorted(upto, min_chars, side="left")))
    return (upto[1:heads + 1].tolist(), carry[1:heads + 1].tolist(), (closed[1:heads + 1] + 1).tolist(), int(upto[-1]))


def applied(f: Summary, entry: int, min_chars: int) -> tuple[int, int]:
    """(count left open, chunks closed) behind ``f``."""
    limits, carry, closed, total = f
    j = int(np.searchsorted(limits, min_chars - entry, side="left"))
    return (carry[j], closed[j]) if j < len(limits) else (entry + total, 0)


def composed(f: Summary, g: Summary, min_chars: int) -> Summary:
    """First ``f``, then ``g``."""
    limits, carry, closed = list(f[0]), [], []
    for c, k in zip(f[1], f[2]):
        c2, k2 = applied(g, c, min_chars)
        carry.append(c2)
        closed.append(k + k2)
    if not limits or limits[-1] < min_chars:
        for limit, c, k in zip(g[0], g[1], g[2]):
            limits.append(f[3] + limit)
            carry.append(c)
            closed.append(k)
            if limits[-1] >= min_chars:
                break
    return limits, carry, closed, f[3] + g[3]


_SUMMARY = "limits array<long>, carry array<long>, closed array<long>, total long"
_LONGS = pa.list_(pa.int64())


def _summaries(t: pa.Table, by: str) -> list[tuple[int, Summary]]:
    rows = zip(*(t.column(c).to_pylist() for c in (by, "limits", "carry", "closed", "total")))
    return sorted((r[0], r[1:]) for r in rows)


def _block_summaries(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [summary_of(np.array(x, np.int64) + CHUNK_SEPARATOR_CHARS, min_chars) for x in b.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("blk"), *(pa.array([m[i] for m in made], _LONGS) for i in range(3)),
                 pa.array([m[3] for m in made], pa.int64())], ["doc_id", "blk", "limits", "carry", "closed", "total"])
    return run


def _compose(min_chars: int):
    def run(t: pa.Table) -> pa.Table:
        found = _summaries(t, "blk")
        f = found[0][1]
        for _, g in found[1:]:
            f = composed(f, g, min_chars)
        return pa.table({"doc_id": t.column("doc_id").slice(0, 1), "span": t.column("span").slice(0, 1),
                         "limits": pa.array([f[0]], _LONGS), "carry": pa.array([f[1]], _LONGS),
                         "closed": pa.array([f[2]], _LONGS), "total": pa.array([f[3]], pa.int64())})
    return run


def _entries(by: str, min_chars: int):
    """Entry count and first chunk number of every row of a group, in the order
    of ``by``; the group starts with what its rows say (null: nothing)."""
    def run(t: pa.Table) -> pa.Table:
        entry, base = ((t.column(c)[0].as_py() if c in t.column_names else None) or 0 for c in ("entry", "base"))
        out = []
        for at, f in _summaries(t, by):
            out.append((at, entry, base))
            entry, k = applied(f, entry, min_chars)
            base += k
        at, entries, bases = zip(*out)
        ids = pa.chunked_array([t.column("doc_id").slice(0, 1).combine_chunks().take(pa.array([0] * len(out)))])
        return pa.table({"doc_id": ids, by: pa.array(at, pa.int64()), "entry": pa.array(entries, pa.int64()),
                         "base": pa.array(bases, pa.int64())})
    return run


def _block_entries(blocks: DataFrame, id_type: str, min_chars: int, span: int) -> DataFrame:
    """(doc_id, blk, entry, base) of every block of the documents with several."""
    summaries = materialize(blocks.mapInArrow(_block_summaries(min_chars), f"doc_id {id_type}, blk long, {_SUMMARY}")
                            .withColumn("span", F.floor(F.col("blk") / span).cast("long")), "block-summaries")
    spans = summaries.groupBy("doc_id", "span").applyInArrow(_compose(min_chars), f"doc_id {id_type}, span long, {_SUMMARY}")
    first = spans.groupBy("doc_id").applyInArrow(_entries("span", min_chars), f"doc_id {id_type}, span long, entry long, base long")
    return summaries.join(first, ["doc_id", "span"]).groupBy("doc_id", "span") \
        .applyInArrow(_entries("blk", min_chars), f"doc_id {id_type}, blk long, entry long, base long")


def pack_passage_rows(passages: DataFrame, order_col: str = "passage_no", text_col: str = "text",
                      min_chars: int = CHUNK_MIN_CHARS, block: int = DEFAULT_BLOCK, span: int = SPAN) -> DataFrame:
    """``(doc_id, <order>, text)`` rows -> ``(doc_id, passage_no, text)``
    chunks, numbered from 0 per document."""
    id_type = passages.schema["doc_id"].dataType.simpleString()
    # a block of ``block`` consecutive order values holds at most ``block`` rows
    blocks = passages.select("doc_id", F.floor(F.col(order_col) / block).cast("long").alias("blk"),
                             F.struct(F.col(order_col).alias("pos"), F.col(text_col).alias("text")).alias("part")) \
        .groupBy("doc_id", "blk").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    blocks = materialize(blocks.withColumn("lengths", F.transform("parts", lambda p: F.length(p["text"]))), "chunk-blocks")
    several = blocks.groupBy("doc_id").agg(F.min("blk").alias("lo"), F.max("blk").alias("hi")).where("lo != hi").select("doc_id")
    several = materialize(several, "long-documents")

    alone = blocks.join(several, "doc_id", "left_anti").select(
        "doc_id", F.explode(chunk_slices(F.col("parts"), chunk_ends(F.col("lengths"), min_chars), lambda p: p["text"])).alias("c"))
    alone = alone.select("doc_id", F.col("c.k").cast("int").alias("passage_no"), F.col("c.text").alias("text"))
    if several.limit(1).count() == 0:
        return alone

    long = blocks.join(several, "doc_id", "left_semi")
    entries = _block_entries(long.select("doc_id", "blk", "lengths"), id_type, min_chars, span)
    cut = long.join(entries, ["doc_id", "blk"]).withColumn("ends", chunk_ends(F.col("lengths"), min_chars, F.col("entry")))
    cut = cut.select("doc_id", "blk", "entry", "base", F.size("ends").alias("n"),
                     F.explode(chunk_slices(F.col("parts"), F.col("ends"), lambda p: p["text"])).alias("c"))
    cut = cut.select("doc_id", "blk", (F.col("base") + F.col("c.k")).cast("int").alias("passage_no"), F.col("c.text").alias("text"),
                     (((F.col("c.k") == 0) & (F.col("entry") > 0)) | (F.col("c.k") == F.col("n"))).alias("edge"))
    # only chunks over a block's end are put together from several rows
    joined = cut.where("edge").groupBy("doc_id", "passage_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("blk", "text"))), lambda s: s["text"]), "\n\n").alias("text"))
    return alone.unionByName(cut.where(~F.col("edge")).select("doc_id", "passage_no", "text")).unionByName(joined)
