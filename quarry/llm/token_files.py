"""Operator 3: token ids as Arrow files of equal-length sequences.

Documents are dealt by ranges of their id and sorted, so file after file holds
them in ascending order. Each task encodes its texts, appends the end id to
every document, and writes one Arrow IPC file of record batches
``(input_ids: fixed_size_list<uint16|uint32>[L], mask: fixed_size_list<bool>[L])``.
Lists have one length and no offsets, so sequence i of a batch is the slice
``[i*L, (i+1)*L)`` of a flat buffer: readers map the file and take any sequence
or document without copying or decoding. The last sequence of a file is padded
with id 0 under a false mask.

A file's name carries its task attempt, and only files named by the written
index count: a lost or repeated task leaves at most an unread file. Executors
write through pyarrow's file systems (local or mounted paths, HDFS, S3, GCS) to
the folder given, by default a new one below ``spark.checkpoint.dir``.

Defined results: null text is an empty document (the end id alone); null ids
come first; rows of equal id are ordered by a hash of their text, each with its
own index row; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, new_folder
from .bpe import library_encoder

SEQUENCE = 2048      # tokens in a sequence
BATCH = 256          # sequences in a record batch
END_ID = 0


def _open_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        scheme, _, rest = folder.partition(":")
        return pafs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else folder)
    return pafs.LocalFileSystem(), folder


class _Writer:
    """Packs ids into sequences and batches of one Arrow file."""

    def __init__(self, sink, dtype, sequence: int, batch: int):
        self.dtype, self.length, self.rows = np.dtype(dtype), sequence, batch
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("input_ids", pa.list_(pa.field("item", item, False), sequence)),
                                 ("mask", pa.list_(pa.field("item", pa.bool_(), False), sequence))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.written += len(ids)
        if self.n_held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = self.length * self.rows
        for lo in range(0, len(ids) if last else len(ids) // step * step, step):
            part = ids[lo:lo + step]
            pad = -len(part) % self.length
            mask = np.ones(len(part) + pad, bool)
            mask[len(part):] = False
            part = np.concatenate([part, np.full(pad, END_ID, self.dtype)]) if pad else part
            self.file.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(part), type=self.schema.field(0).type),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field(1).type)], schema=self.schema))
        self.held = [] if last else [ids[len(ids) // step * step:]]
        self.n_held = sum(map(len, self.held))

    def close(self) -> None:
        self._flush(True)
        self.file.close()


def _write_files(path: str, folder: str, sequence: int, batch: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.arrow"
        enc, writer, sink, seen = library_encoder(path), None, None, 0
        try:
            for b in batches:
                if writer is None and b.num_rows:
                    fs, where = _open_fs(name)
                    fs.create_dir(where.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(where)
                    size = enc.splitter.tokenizer.get_vocab_size()
                    writer = _Writer(sink, np.uint16 if size <= 1 << 16 else np.uint32, sequence, batch)
                first, count = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                open_row, end = None, np.array([END_ID])

                def finish(row):
                    writer.add(end)
                    count[row] = writer.written - first[row]

                for rows, ids, n in enc.ids(b.column("text").to_pylist()):
                    at = np.concatenate([[0], np.cumsum(n)])
                    for i, row in enumerate(rows):
                        if row != open_row:
                            if open_row is not None:
                                finish(open_row)
                            open_row, first[row] = row, writer.written
                        writer.add(ids[at[i]:at[i + 1]])
                if open_row is not None:
                    finish(open_row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task.partitionId()] * b.num_rows, pa.int32()), pa.array([name] * b.num_rows, pa.string()),
                     b.column("doc_id").cast(id_type), pa.array(np.arange(seen, seen + b.num_rows), pa.int64()),
                     pa.array(first, pa.int64()), pa.array(count, pa.int64())],
                    ["part", "file", "doc_id", "nth", "first", "n_tokens"])
                seen += b.num_rows
            if writer is not None:
                writer.close()
        finally:
            if sink is not None:
                sink.close()
    return run


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text", sequence: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Writes the files and returns their index, itself a written table:
    (part, file, doc_id, nth, first, n_tokens, start); ``first`` counts ids
    within the file, ``start`` over all files."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    # a repeated id is dealt by its texts' hashes, repeated rows by their place in the input
    order = ["doc_id", "h", "place"]
    ranged = rows.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()}) \
        .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    index = materialize(ranged.mapInArrow(
        _write_files(path, folder, sequence, batch, to_arrow_type(id_type)),
        f"part int, file string, doc_id {id_type.simpleString()}, nth long, first long, n_tokens long"), "token-index")
    # one row per file; the running total is over the number of files only
    sums = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("file", F.coalesce(before, F.lit(0)).alias("offset"))
    return index.join(offsets, "file").withColumn("start", F.col("offset") + F.col("first")).drop("offset")


class TokenFile:
    """Random access to one file; local files are mapped, nothing is copied
    but a document that spans record batches."""

    def __init__(self, name: str):
        fs, where = _open_fs(name)
        source = pa.memory_map(where) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(where)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self._batch = lru_cache(maxsize=2)(self._read)
        first = self._batch(0) if self.reader.num_record_batches else None
        self.per_batch = len(first[0]) if first else 0

    def _read(self, i: int) -> tuple[np.ndarray, pa.Array]:
        b = self.reader.get_batch(i)
        return b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i of the file and its mask."""
        k, j = divmod(i * self.length, self.per_batch)
        ids, mask = self._batch(k)
        return ids[j:j + self.length], mask[j // self.length].values.to_numpy(zero_copy_only=False)

    def span(self, first: int, n: int) -> np.ndarray:
        """Ids [first, first + n) of the file."""
        got = []
        while n > 0:
            k, j = divmod(first, self.per_batch)
            part = self._batch(k)[0][j:j + n]
            got.append(part)
            first, n = first + len(part), n - len(part)
        return got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, np.uint16)


@lru_cache(maxsize=2)
def open_token_file(name: str) -> TokenFile:
    return TokenFile(name)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = [zlib.crc32(open_token_file(f).span(i, n).astype("<u4").tobytes())
               for f, i, n in zip(*(b.column(c).to_pylist() for c in ("file", "first", "n_tokens")))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"),
                                          pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_checksums(index: DataFrame) -> DataFrame:
    """Reads every document back from the files: (doc_id, start, n_tokens,
    ids_crc32 of its ids as little-endian unsigned 32-bit integers)."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = index.schema["doc_id"].dataType.simpleString()
    # rows of a file stay together, so each file is opened by one or two tasks
    return index.select("part", "file", "doc_id", "first", "n_tokens", "start") \
        .repartitionByRange(n, "part", "first").sortWithinPartitions("part", "first") \
        .mapInArrow(_checksums, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
