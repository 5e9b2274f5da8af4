"""Operator 11: centroid clustering by dimension-sharded Lloyd.

Vectors are packed once, where they are read, into cells: up to ``CHUNK`` rows by one
of ``SHARDS`` blocks of columns, written as one table per column block. A round is

1. every cell gives the exact partial squared distances of its rows to its
   block's slice of every centroid (a column-block task knows only its slice);
2. partial distances are reduced by chunk: the blocks' matrices are added, the
   smallest sum wins (ties: the smaller number);
3. every cell adds its rows by assigned centroid, each task sums what it meets
   before the shuffle, and each shard's own slice of the centroids is updated
   from the sums. Only ``k`` times the dimensions numbers reach the driver.

Assignments of a round are a table in the shared folder, so a lost executor
repeats one round's step at most. All arithmetic is on 64-bit integers.

Defined results: a vector takes part when it has exactly ``dims`` components, none
null or non-finite, and others give no row; components of an absolute value above
``LIMIT`` (in the integer scale) count as the limit, so that no distance
overflows; a null id hashes as the empty string; rows of equal id are rows of their own
(two may start as centroids; ties of the hash by components); with fewer than
``k`` vectors there are as many centroids as vectors; sums beyond a long count as its
largest value; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, new_folder
from .vectors import finite

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
SHARDS = 4
CHUNK = 1024
LIMIT = 1 << 27
_LONG = (1 << 63) - 1


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def _cells(dims: int, shards: int, scale: int):
    """(vec_id, vector) to (chunk, block, rows, x, ids); ids with block 0 only."""
    cuts = np.linspace(0, dims, shards + 1).astype(int).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                ids = part.column("vec_id")
                x = quantised(part.column("vector").flatten().to_numpy(zero_copy_only=False), scale).astype("<i4")
                x = x.reshape(part.num_rows, dims)
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)] + [len(ids)] * (shards - 1), pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * shards, pa.int64()), pa.array(range(shards), pa.int32()),
                     pa.array([part.num_rows] * shards, pa.int32()),
                     pa.array([x[:, i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()), listed],
                    ["chunk", "block", "rows", "x", "ids"])
                chunk += 1
    return run


def _matrix(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, "<i4").reshape(rows, -1).astype(np.int64)


def _partial(slices: list[np.ndarray]):
    """Cells to (chunk, part): rows by centroids, distances within the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, block, rows, x in zip(*(b.column(k).to_pylist() for k in ("chunk", "block", "rows", "x"))):
                x = _matrix(x, rows)
                own = np.empty((rows, len(slices[block])), np.int64)
                for k, c in enumerate(slices[block]):
                    own[:, k] = ((x - c) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([own.tobytes()], pa.binary())],
                                                 ["chunk", "part"])
    return run


def _nearest(k: int):
    """A chunk's partial distances to (chunk, cluster, distance) lists."""
    def run(t: pa.Table) -> pa.Table:
        total = 0
        for part in t.column("part").to_pylist():
            total = total + np.frombuffer(part, np.int64).reshape(-1, k)
        cluster = total.argmin(axis=1)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "cluster": pa.array([cluster.tolist()], pa.list_(pa.int32())),
                         "distance": pa.array([total[np.arange(len(total)), cluster].tolist()], pa.list_(pa.int64()))})
    return run


def _sums(cuts: list[int], k: int):
    """(block, rows, x, cluster) to a task's (dim, sums, counts) by centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((cuts[-1], k), np.int64), np.zeros((cuts[-1], k), np.int64)
        for b in batches:
            for block, rows, x, cluster in zip(*(b.column(c).to_pylist() for c in ("block", "rows", "x", "cluster"))):
                x, cluster = _matrix(x, rows), np.array(cluster)
                lo, hi = cuts[block], cuts[block + 1]
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                which = cluster[order][first]
                total[lo:hi, which] += np.add.reduceat(x[order], first, axis=0).T
                count[lo:hi, which] += np.diff(first, append=rows)
        seen = np.flatnonzero(count.any(axis=1))
        if len(seen):
            at = np.repeat(seen, k)
            which = np.tile(np.arange(k), len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(which, pa.int32()),
                                              pa.array(total[at, which]), pa.array(count[at, which])],
                                             ["dim", "cluster", "total", "n"])
    return run


def lloyd(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
          dims: int = DIMS, scale: int = SCALE, seed: int = SEED, shards: int = SHARDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the last assignment, one row per vector that
    takes part, and the final centroids (k by dims; none for an empty table)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")) \
        .where(finite(F.col("vector")) & (F.size("vector") == dims))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(digest.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    empty = spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long")
    if not first:
        return empty, np.zeros((0, dims), np.int64)
    centroids = quantised(np.array([r["vector"] for r in first]), scale)
    k = len(centroids)
    cuts = np.linspace(0, dims, shards + 1).astype(int).tolist()

    path = new_folder(spark, "cells")
    schema = f"chunk long, block int, rows int, x binary, ids array<{id_type}>"
    rows.mapInArrow(_cells(dims, shards, scale), schema).write.partitionBy("block").parquet(path)
    cells = spark.read.schema(schema).parquet(path)

    def assigned(centroids: np.ndarray) -> DataFrame:
        slices = [centroids[:, i:j] for i, j in zip(cuts, cuts[1:])]
        parts = cells.select("chunk", "block", "rows", "x").mapInArrow(_partial(slices), "chunk long, part binary")
        return materialize(parts.groupBy("chunk").applyInArrow(
            _nearest(k), "chunk long, cluster array<int>, distance array<long>"), "assigned")

    found = assigned(centroids)
    for _ in range(rounds):
        sums = cells.select("chunk", "block", "rows", "x").join(found.select("chunk", "cluster"), "chunk") \
            .select("block", "rows", "x", "cluster") \
            .mapInArrow(_sums(cuts, k), "dim int, cluster int, total long, n long") \
            .groupBy("dim", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect()
        centroids = centroids.copy()
        for r in sums:
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]
        found = assigned(centroids)
    pairs = cells.where("block = 0").select("chunk", "ids").join(found, "chunk") \
        .select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("r"))
    return pairs.select(F.col("r.ids").alias("vec_id"), F.col("r.cluster").alias("cluster"), F.col("r.distance").alias("distance")), centroids


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    pairs, centroids = lloyd(vectors, id_col, vector_col, **settings)
    spark = vectors.sparkSession
    total = {r["cluster"]: int(r["total"]) for r in pairs.groupBy("cluster")
             .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(sum(total.values()), _LONG)
    about = [(i, min(total.get(i, 0), _LONG), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
             for i, c in enumerate(centroids.tolist())]
    # one row per centroid: bounded by k
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return pairs.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> str:
    """The same as one DuckDB statement (finite, moderate components)."""
    near = """a{r} AS MATERIALIZED (
  SELECT i, min_by(cluster, (dist, cluster)) AS cluster, min(dist) AS dist FROM (
    SELECT v.i, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS dist FROM e v JOIN c{r} c ON c.d = v.d GROUP BY 1, 2) GROUP BY i)"""
    step = """c{n} AS MATERIALIZED (
  SELECT c.cluster, c.d, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT a.cluster, v.d, ((sum(v.x) - (((sum(v.x) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS x
    FROM a{r} a JOIN e v ON v.i = a.i GROUP BY 1, 2) s ON s.cluster = c.cluster AND s.d = c.d)"""
    steps = []
    for r in range(rounds):
        steps += [near.format(r=r), step.format(r=r, n=r + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, embedding, sha256('{seed}:' || vec_id::VARCHAR) AS h FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (
  SELECT i, d, floor(256 * embedding[d]::DOUBLE)::BIGINT AS x FROM v, range(1, {dims + 1}) AS t(d)),
c0 AS MATERIALIZED (
  SELECT f.cluster, e.d, e.x FROM (SELECT i, row_number() OVER (ORDER BY h) - 1 AS cluster FROM v ORDER BY h LIMIT {k}) f
  JOIN e ON e.i = f.i),
{", ".join(steps)},
{near.format(r=rounds)},
s AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY 1),
t AS (SELECT cluster, sum(dist)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.dist::BIGINT AS distance, t.cluster_inertia,
       (SELECT sum(dist) FROM a{rounds})::BIGINT AS inertia, s.centroid_sha256
FROM a{rounds} a JOIN v ON v.i = a.i JOIN s ON s.cluster = a.cluster JOIN t ON t.cluster = a.cluster
"""
