"""Operator 1: exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length, longest first, and cut into blocks; within a block
buckets of ``BUCKET`` vectors of nearly equal length are probed in turn. For a
query q with a proven lower bound t on its k-th best product, a vector of a
bucket with greatest length l can only count if its cosine with q reaches the
local threshold ``t / (|q| l)``:

* above 1 the bucket is skipped whole (length pruning),
* at ``COORDINATE_FROM`` or more, the query's three heaviest coordinates bound
  the same coordinates of any such vector: candidates are those inside all three
  intervals (coordinate pruning),
* below, candidates are the vectors of length ``t / |q|`` or more (length pruning).

Products of candidates are verified exactly and raise t. The first bounds come
from the longest block, against which all queries are run first. A block whose
longest vector cannot reach a query's bound is pruned before anything is copied:
a query goes to the blocks it can need, a block to the groups of queries that need it.

Components are integers ``floor(scale * x)``. Products are exact: in doubles while
every partial sum stays below 2^53, else in Python integers (limited to the
range of a long).

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as filled up with zeros; rows of a null id are
candidates (last in ties); repeated ids are rows of their own: every query row has its own k
places and leaves out itself only; ties go to the smaller id, then to the earlier row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .vectors import BLOCK, by_key, finite, in_blocks, matrix

BUCKET = 512
COORDINATE_FROM = 0.7
QUERY_BLOCK = 1024
_LONG = 2**63 - 1


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, as int64."""
    if v.size == 0 or q.size == 0:
        return np.zeros((len(q), len(v)), np.int64)
    if np.abs(q).max() * np.abs(v).max() * v.shape[1] < 2**53:
        return (q @ v.T).astype(np.int64)
    vi = [[int(x) for x in r] for r in v]
    return np.array([[max(-_LONG, min(_LONG, sum(a * b for a, b in zip(r, s)))) for s in vi]
                     for r in ([int(x) for x in r] for r in q)], np.int64)


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, w - m.shape[1]))) if m.shape[1] < w else m for m in (a, b))


class _Best:
    """The k best (score, place) of every query so far; ties to the smaller place."""

    def __init__(self, n: int, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.copy()
        self.score = np.zeros((n, 0), np.int64)
        self.ids = np.zeros((n, 0), np.int64)
        self.have = np.zeros((n, 0), bool)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, score.shape)], axis=1)
        h = np.concatenate([self.have[rows], ok], axis=1)
        if s.shape[1] > 4 * self.k:   # keep what can still be among the k best
            part = np.where(h, s, -_LONG)
            kth = -np.partition(-part, self.k - 1, axis=1)[:, self.k - 1]
            most = int((h & (part >= kth[:, None])).sum(axis=1).max())
            top = np.argsort(~(h & (part >= kth[:, None])), axis=1, kind="stable")[:, :max(most, self.k)]
            s, i, h = (np.take_along_axis(x, top, axis=1) for x in (s, i, h))
        order = np.lexsort((i, -s.astype(np.float64), ~h), axis=1)
        s, i, h = (np.take_along_axis(x, order, axis=1) for x in (s, i, h))
        # doubles order longs but for the last bits: mend neighbours that tie as doubles
        if s.size and np.abs(s).max() >= 2**53:
            for r in range(len(s)):
                o = sorted(range(s.shape[1]), key=lambda j: (not h[r, j], -int(s[r, j]), int(i[r, j])))
                s[r], i[r], h[r] = s[r, o], i[r, o], h[r, o]
        s, i, h = s[:, :self.k], i[:, :self.k], h[:, :self.k]
        if s.shape[1] > self.score.shape[1]:
            grow = s.shape[1] - self.score.shape[1]
            self.score, self.ids, self.have = (np.pad(x, ((0, 0), (0, grow))) for x in (self.score, self.ids, self.have))
        w = s.shape[1]
        self.score[rows, :w], self.ids[rows, :w], self.have[rows, :w] = s, i, h
        if w == self.k:
            full = h[:, -1]
            self.bound[rows[full]] = np.maximum(self.bound[rows[full]], s[full, -1])


def _probe(queries: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, vectors: np.ndarray, v_ids: np.ndarray,
           k: int) -> _Best:
    """Best of ``vectors`` (longest first) for every query above its bound."""
    queries, vectors = _aligned(queries, vectors)
    best = _Best(len(queries), k, bound)
    q_len, v_len = np.sqrt((queries**2).sum(axis=1)), np.sqrt((vectors**2).sum(axis=1))
    unit_q = queries / np.where(q_len > 0, q_len, 1)[:, None]
    slack = 1 + 1e-9
    for lo in range(0, len(vectors), BUCKET):
        v, ids, length = vectors[lo:lo + BUCKET], v_ids[lo:lo + BUCKET], v_len[lo:lo + BUCKET]
        order = np.argsort(-length, kind="stable")
        v, ids, length = v[order], ids[order], length[order]
        reach = q_len * length[0]
        need = best.bound / np.where(reach > 0, reach, 1)
        live = (best.bound <= 0) | (need <= slack)
        sharp = live & (best.bound > 0) & (need >= COORDINATE_FROM)
        unit = v / np.where(length > 0, length, 1)[:, None]
        for r in np.flatnonzero(sharp):
            t = min(1.0, need[r] / slack)
            focus = np.argsort(-np.abs(unit_q[r]))[:3]
            mid, half = unit_q[r, focus] * t, np.sqrt((1 - t * t) * np.maximum(0, 1 - unit_q[r, focus]**2))
            p = unit[:, focus]
            # for cosines from t to 1 the interval's upper end is widest at t or reaches 1
            up = np.where(unit_q[r, focus] >= t, 1.0, mid + half)
            down = np.where(unit_q[r, focus] <= -t, -1.0, mid - half)
            c = np.flatnonzero(((p <= up + 1e-9) & (p >= down - 1e-9)).all(axis=1))
            if len(c):
                best.add(np.array([r]), _products(v[c], queries[r:r + 1]), ids[c], (ids[c] != q_ids[r])[None])
        rest = np.flatnonzero(live & ~sharp)
        if len(rest):
            floor = np.where(q_len[rest] > 0, best.bound[rest] / np.where(q_len[rest] > 0, q_len[rest], 1), 0)
            floor = np.where(best.bound[rest] > 0, floor, 0).min()
            z = int(np.searchsorted(-length, -floor / slack, "right"))
            if z:
                best.add(rest, _products(v[:z], queries[rest]), ids[:z], ids[None, :z] != q_ids[rest, None])
    return best


def _search(k: int):
    """Rows of a query group and a block to (query, row, score) by places: a
    candidate's place follows (id, row) within the block."""
    def run(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        is_query = t.column("is_query").to_numpy().astype(bool)
        v = matrix(t.column("v").combine_chunks())
        row, bound = t.column("row").to_numpy(), t.column("bound").to_numpy()
        by_id = np.lexsort((row, t.column("vec_id").fill_null(_LONG).to_numpy(), t.column("vec_id").is_null().to_numpy()))
        place = np.empty(len(row), np.int64)
        place[by_id] = np.arange(len(row))
        # a query's own place: that of its row among the candidates, if it lies in this block
        at = dict(zip(row[~is_query].tolist(), place[~is_query].tolist()))
        length = t.column("len").to_numpy()
        order = np.flatnonzero(~is_query)
        order = order[np.argsort(-length[order], kind="stable")]
        q = np.flatnonzero(is_query)
        if not len(q) or not len(order):
            return
        own = np.array([at.get(r, -1) for r in row[q].tolist()], np.int64)
        best = _probe(v[q], own, bound[q], v[order], place[order], k)
        r, c = np.nonzero(best.have)
        found = by_id[best.ids[r, c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[q][r]), pa.array(row[found]), t.column("vec_id").combine_chunks().take(pa.array(found)), pa.array(best.score[r, c])],
            ["query", "row", "vec_id", "score"])
    return by_key(["qb", "block"], run)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
          scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): every query row's k best other rows."""
    rows = table.where(finite(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        # whole numbers as doubles: floor() of a large double is no long
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    rows = rows.withColumns({"len": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "row": F.monotonically_increasing_id()})
    data = in_blocks(rows, [F.desc("len"), "vec_id", "row"], block)
    queries = data.where("is_query").select("row", "vec_id", "v", "len")
    n_q = queries.count()
    n_qb = max(1, -(-n_q // QUERY_BLOCK))
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(n_qb)).cast("int"))
    # one number for every block of 4096 vectors
    longest = [r["longest"] for r in data.groupBy("block").agg(F.max("len").alias("longest")).orderBy("block").collect()]
    cols = ["qb", "block", "is_query", "row", "vec_id", "v", "len", "bound"]

    def search(asked: DataFrame) -> DataFrame:
        """Query rows with the ``block`` they go to, against that block's vectors."""
        needed = asked.select("qb", "block").distinct()
        left = data.join(needed, "block").withColumns({"is_query": F.lit(False), "bound": F.lit(0.0)})
        return left.select(cols).unionByName(asked.withColumn("is_query", F.lit(True)).select(cols)) \
            .repartition("qb", "block").sortWithinPartitions("qb", "block") \
            .mapInArrow(_search(k), "query long, row long, vec_id long, score long")

    if not longest or not n_q:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = materialize(search(queries.withColumns({"block": F.lit(0), "bound": F.lit(0.0)})), "first-block")
    if len(longest) > 1:
        kth = _ranked(found, k).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("bound"))
        asked = queries.join(kth, "row", "left").withColumn("bound", F.greatest(F.lit(0.0), F.coalesce("bound", F.lit(0.0))))
        # blocks come longest first: those a query can need are the first ones
        reach = F.size(F.filter(F.lit(longest[1:]).cast("array<double>"), lambda x: x * F.col("len") * (1 + 1e-9) >= F.col("bound")))
        asked = asked.withColumn("reach", reach).where("reach > 0") \
            .withColumn("block", F.explode(F.sequence(F.lit(1), F.col("reach")))).drop("reach")
        found = found.unionByName(search(asked))
    ids = data.where("is_query").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return _ranked(found, k).join(ids, "query").select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.i AS q, q.vec_id AS query_id, c.vec_id, c.i, list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)])::BIGINT AS score
      FROM v q JOIN v c ON q.i <> c.i WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, i)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
