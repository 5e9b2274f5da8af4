"""Operator 9: BPE encoding and decoding through a transducer lexicon.

1. Word counts over the whole corpus: tasks split texts into the tokenizer's
   words and count them per slice; Spark adds the counts up (partial sums
   before the shuffle).
2. The most frequent words, as many whole frequency steps as fit into
   ``lexicon_words``, reach the driver (a bound that does not grow with the
   corpus; words met once are left out) and are compiled with their ids
   into a minimal acyclic transducer. Its file (a few MB) goes to every executor
   as a Spark file and is memory-mapped by the workers.
3. Every text is encoded: known words by the transducer, all others by exact
   merging. The lexicon changes the speed only, never the ids.
4. Decoding joins the ids' bytes and reads them as UTF-8, replacing what is
   invalid, as the library's byte-level decoder does.

Defined results: null text is encoded as empty; null ids and repeated rows are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import driver_folder, materialize
from .bpe import Encoder, WordSplitter, byte_letters, check_supported, ragged, slices
from .lexicon import Transducer, compile_words, write_transducer
from .merges import MergeWords

LEXICON_WORDS = 65_536


@lru_cache(maxsize=2)
def _splitter(path: str) -> WordSplitter:
    return WordSplitter(path)


@lru_cache(maxsize=2)
def _merges(path: str) -> MergeWords:
    return MergeWords(check_supported(path))


@lru_cache(maxsize=2)
def _encoder(path: str, lexicon: str) -> Encoder:
    return Encoder(_splitter(path), Transducer(SparkFiles.get(lexicon), _merges(path)))


def _count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(path)
        for b in batches:
            for _, parts in slices(b.column("text").to_pylist()):
                words = splitter.split(parts)[0]
                if len(words):
                    got = pc.value_counts(words)
                    yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["word", "n"])
    return run


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word binary, n long): every word of every text with its count."""
    return docs.select(F.col(text_col).alias("text")).where("text != ''") \
        .mapInArrow(_count_words(path), "word binary, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words and hands the file to the executors;
    returns the name by which they find it."""
    # counts in steps of an eighth of a doubling: at most a few hundred rows tell where to cut
    counted = materialize(word_counts(docs, path, text_col).where("n > 1")
                          .withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "word-counts")
    cut, total = None, 0
    for r in counted.groupBy("step").count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > words:
            break
        cut = r["step"]
    top = counted.where(F.col("step") >= cut).select("word").collect() if cut is not None else []
    frequent = sorted(bytes(r[0]) for r in top)
    flat, counts = _merges(path).resolve(pa.array(frequent, pa.binary()))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = os.path.join(driver_folder(), name)
    write_transducer(compile_words(frequent, flat, counts), file)
    docs.sparkSession.sparkContext.addFile(file)
    return name


class Decoder:
    """ids -> bytes, by a table of every token's bytes."""

    def __init__(self, spec: dict):
        back = {chr(c): b for b, c in byte_letters().items()}
        tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        table = [b""] * (max(tokens) + 1)
        for i, t in tokens.items():
            known = all(c in back for c in t)
            table[i] = bytes(back[c] for c in t) if known else t.encode()
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, where each id's bytes end)."""
        size = self.size[ids]
        return ragged(self.data, self.start[ids], size), np.cumsum(size)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(check_supported(path))


def _encode(path: str, lexicon: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = _encoder(path, lexicon), _decoder(path)
        for b in batches:
            doc_ids = b.column("doc_id")
            open_row, open_ids, open_bytes = None, [], []
            rows_out, n_out, ids_out, text_out = [], [], [], []

            def finish():
                ids, raw = b"".join(open_ids), b"".join(open_bytes)
                rows_out.append(open_row)
                n_out.append(len(ids) // 4)
                ids_out.append(ids)
                text_out.append(raw.decode("utf-8", "replace"))
                open_ids.clear()
                open_bytes.clear()

            def batch():
                out = pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows_out, pa.int64())), pa.array(n_out, pa.int64()),
                     pa.array(ids_out, pa.binary()), pa.array(text_out, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"])
                for x in (rows_out, n_out, ids_out, text_out):
                    x.clear()
                return out

            for rows, ids, n in enc.ids(b.column("text").to_pylist()):
                raw, byte_end = dec.joined(ids)
                byte_end = np.concatenate([[0], byte_end])
                at = np.concatenate([[0], np.cumsum(n)])
                for i, row in enumerate(rows):
                    if row != open_row and open_row is not None:
                        finish()
                    open_row = row
                    open_ids.append(ids[at[i]:at[i + 1]].astype("<u4").tobytes())
                    open_bytes.append(raw[byte_end[at[i]]:byte_end[at[i + 1]]].tobytes())
                if rows_out:
                    yield batch()
            if open_row is not None:
                finish()
                yield batch()
    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ``ids`` is binary, little-endian
    unsigned 32-bit integers; ``decoded`` the text read back from them."""
    lexicon = build_lexicon(docs, path, text_col, lexicon_words)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(path, lexicon), f"doc_id {id_type}, n_tokens long, ids binary, decoded string")
