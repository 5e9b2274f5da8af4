"""Operator 5: quality classifier by a factorisation machine.

Features of a whole text: its lower-cased words hashed into ``BUCKETS`` (counts,
scaled to length 1), and structure statistics and lengths, each as a number and
as one of ``BINS`` ranges. The machine scores

    w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]

in time linear in the features: the square of the sum less the sum of squares
gives all pairwise interactions of rank ``RANK``.

Training takes a bounded sample: about ``SAMPLE_ROWS`` labelled ids, chosen by a
hash of the id among those whose crc32(id) mod 5 is not 0, whatever the size
of the corpus, and of each the row of the smallest text hash. Their features are made by the executors; the driver fits by
Adam with a fixed seed, so reruns agree. Scoring runs over every text in
parallel with the model (about a megabyte) in the task. Labels, language,
source and id are no inputs of a score.

Defined results: null text scores as the empty text; null ids are kept, count
as the empty string for the fold and never train; several labels of one id
count as their smallest; without usable labels every score is 0.5; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .slices import binary_slices, give_back, slim

BUCKETS = 1 << 14
RANK = 8
BINS = 8
SAMPLE_ROWS = 20_000
ACCEPT = 0.3
EPOCHS = 8
LEAST_STEPS = 400     # a small sample is gone through more often
SEED = 11

_CLASSES = 8   # lower, upper, digit, stop or comma, other ASCII sign, space, line end, non-ASCII
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[46, 44]], _CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]] = 3, 5, 6
STATISTICS = 14
FEATURES = BUCKETS + STATISTICS * (1 + BINS)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of ``texts``: (feature ids, values, entries per text)."""
    n = len(texts)
    words, at = S.word_hashes(texts)
    per = np.diff(at)
    doc = np.repeat(np.arange(n), per)
    bucket = (words >> np.uint64(40)).astype(np.int64) % BUCKETS
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    row = key // BUCKETS
    length = np.sqrt(np.bincount(row, count.astype(float) ** 2, n))
    value = count / length[row]
    kinds = np.bincount(row, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    # two-word sequences that differ, of all
    pair = S.mix(words[:-1] * np.uint64(31) + words[1:]) if len(words) > 1 else words[:0]
    inside = doc[:-1] == doc[1:] if len(words) > 1 else np.zeros(0, bool)
    pair_doc = doc[:-1][inside] if len(words) > 1 else doc[:0]
    both = np.unique(np.stack([pair_doc.astype(np.uint64), pair[inside] >> np.uint64(8)]), axis=1) if len(pair_doc) else np.zeros((2, 0))
    pairs, distinct_pairs = np.bincount(pair_doc, minlength=n), np.bincount(both[0].astype(np.int64), minlength=n)
    size = np.fromiter(map(len, texts), np.int64, n)
    data = np.frombuffer(b"".join(texts), np.uint8)
    chars = np.bincount(np.repeat(np.arange(n), size) * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    share = chars / np.maximum(size, 1)[:, None]
    w = np.maximum(per, 1)
    stats = np.stack([*share.T, kinds / w, top / w, distinct_pairs / np.maximum(pairs, 1),
                      np.minimum(1, size / w / 20), np.minimum(1, np.log1p(per) / 12), np.minimum(1, np.log1p(size) / 14)], axis=1)
    bins = np.minimum(BINS - 1, (np.sqrt(stats) * BINS).astype(np.int64))
    k = np.arange(STATISTICS)
    ids = np.concatenate([np.broadcast_to(BUCKETS + k, (n, STATISTICS)), BUCKETS + STATISTICS + k * BINS + bins], axis=1)
    values = np.concatenate([stats, np.full((n, STATISTICS), 0.5)], axis=1)
    rows = np.concatenate([row, np.repeat(np.arange(n), 2 * STATISTICS)])
    order = np.argsort(rows, kind="stable")
    return (np.concatenate([key % BUCKETS, ids.ravel()])[order], np.concatenate([value, values.ravel()])[order],
            kinds + 2 * STATISTICS)


class Machine:
    """A factorisation machine over FEATURES inputs."""

    def __init__(self, rank: int = RANK, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(FEATURES)
        self.v = rng.normal(0, 0.02, (FEATURES, rank))

    def raw(self, ids: np.ndarray, x: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score before the logistic, sums of v x) of rows with entries."""
        start = np.cumsum(per) - per
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, start, axis=0)
        squares = np.add.reduceat((vx ** 2).sum(axis=1), start)
        return self.bias + np.add.reduceat(self.w[ids] * x, start) + 0.5 * ((s ** 2).sum(axis=1) - squares), s

    def scores(self, ids: np.ndarray, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, x, per)[0], -30, 30)))

    def fit(self, ids: np.ndarray, x: np.ndarray, per: np.ndarray, y: np.ndarray, epochs: int = EPOCHS,
            batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        start = np.cumsum(per) - per
        mean = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(mean / (1 - mean)))
        rank = self.v.shape[1]
        moment = [np.zeros(FEATURES), np.zeros(FEATURES), np.zeros_like(self.v), np.zeros_like(self.v)]
        step, per_epoch = 0, max(1, len(y) // batch)
        for _ in range(max(epochs, -(-LEAST_STEPS // per_epoch))):
            for rows in np.array_split(rng.permutation(len(y)), per_epoch):
                n = per[rows]
                at = np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                i, xi = ids[at], x[at]
                z, s = self.raw(i, xi, n)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                gi = np.repeat(g, n)
                gw = np.bincount(i, gi * xi, FEATURES) + decay * self.w
                inner = (np.repeat(s, n, axis=0) - self.v[i] * xi[:, None]) * (gi * xi)[:, None]
                gv = np.stack([np.bincount(i, inner[:, f], FEATURES) for f in range(rank)], axis=1) + decay * self.v
                step += 1
                self.bias -= rate * float(g.sum())
                for p, grad, m, q in ((self.w, gw, moment[0], moment[1]), (self.v, gv, moment[2], moment[3])):
                    m *= 0.9
                    m += 0.1 * grad
                    q *= 0.999
                    q += 0.001 * grad ** 2
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.999 ** step)) + 1e-8)


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) to (doc_id, label, ids, values), each id once a task: one
    row's entries as bytes."""
    seen: set = set()
    for b in batches:
        new = [not (d in seen or seen.add(d)) for d in b.column("doc_id").to_pylist()]
        b = b.filter(pa.array(new, pa.bool_()))
        for lo, texts in binary_slices(b.column("text")):
            ids, x, per = features(texts)
            end = np.cumsum(per)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(lo, len(texts)), b.column("label").slice(lo, len(texts)),
                 pa.array([ids[e - k:e].astype(np.int32).tobytes() for e, k in zip(end, per)], pa.binary()),
                 pa.array([x[e - k:e].astype(np.float32).tobytes() for e, k in zip(end, per)], pa.binary())],
                ["doc_id", "label", "ids", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """Fits on about ``sample_rows`` labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")) \
        .where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")) \
        .where(fold(F.col("doc_id")) != 0)
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * sample_rows / n))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    # the sample is bounded by sample_rows, so it may be broadcast; of a repeated id one row is left,
    # first by its text's hash, then of equal rows: in every task, and again behind the shuffle
    chosen = texts.select("doc_id", "h").join(F.broadcast(known), "doc_id").groupBy("doc_id") \
        .agg(F.min("h").alias("h"), F.min("label").alias("label"))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "h"]).select("doc_id", "label", "text") \
        .mapInArrow(slim(_rows), f"doc_id {id_type}, label double, ids binary, x binary") \
        .groupBy("doc_id").agg(F.first("label").alias("label"), F.first("ids").alias("ids"), F.first("x").alias("x")).toArrow()
    rows = rows.sort_by("doc_id")
    y = rows.column("label").to_numpy()
    if not len(y) or (y == y[0]).all():
        return None
    ids, x = (np.frombuffer(b"".join(part.as_buffer() for part in rows.column(c)), kind) for c, kind in (("ids", np.int32), ("x", np.float32)))
    per = pc.binary_length(rows.column("ids")).to_numpy() // 4
    del rows
    machine = Machine()
    machine.fit(ids, x, per, y)
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
    give_back()
    return machine


def _score(machine: Machine | None, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in binary_slices(b.column(text_col)):
                score = machine.scores(*features(texts)) if machine is not None else np.full(len(texts), 0.5)
                part = b.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*b.schema.names, name])
    return run


def scored(docs: DataFrame, machine: Machine | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one column more, the score."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(slim(_score(machine, text_col, name)), f"{fields}, `{name}` double")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all their columns, that the classifier accepts."""
    name = "score"
    while name in docs.columns:
        name += "_"
    machine = train(docs, labels, id_col, text_col, label_col)
    return scored(docs, machine, text_col, name).where(F.col(name) >= accept).drop(name)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    machine = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, machine).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= accept, 1).otherwise(0).alias("predicted"))
