"""Operator 2: embedding near-duplicates by collision-counting projections.

Every unit vector is projected on ``PROJECTIONS`` random orthonormal
directions. A pair collides on a projection when one lies in the window of
half-width h around the other. Near pairs (cosine >= threshold) differ by at most
``sqrt(2 - 2 * threshold)`` and collide on nearly all projections, others on about
half of them; pairs whose count reaches the calibrated number are verified by
their cosine in double precision. The number is calibrated for recall: the
smallest count met among ``CALIBRATION`` simulated pairs exactly at the threshold
(in random directions, with the same projections and rounding), less one; closer
pairs collide more often.

The first projection sorts the vectors into blocks of about ``BLOCK``. Blocks
further apart on it than any calibrated pair are not compared; each remaining
pair of blocks is one task's work, in which counts are sums of byte
comparisons. Tasks give link counts per vector and a forest of their links, never
the links themselves, so a large group of near copies costs a row per vector and
block pair. Equal vectors form one class beforehand.

Defined results: vectors that are null, zero or hold null or non-finite
components link with nothing and are kept; vectors of different dimension never
link; null ids are kept and take part (a component of null ids alone is null);
repeated ids are rows of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .vectors import BLOCK, by_key, finite, in_blocks, matrix, norm

PROJECTIONS = 32
WINDOW = 2.0          # half-width in standard deviations of a pair at the threshold
CELLS = 6             # byte cells in a half-width
CALIBRATION = 200_000
TILE = 256


@lru_cache(maxsize=8)
def directions(dim: int, count: int = PROJECTIONS) -> np.ndarray:
    """Seeded random directions, orthonormal in groups of ``dim``."""
    rng = np.random.default_rng(20_240_601 + dim)
    parts = []
    while sum(p.shape[1] for p in parts) < count:
        parts.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.concatenate(parts, axis=1)[:, :count]


def _cell(dim: int, threshold: float) -> float:
    return WINDOW * np.sqrt((2 - 2 * threshold) / dim) / CELLS


def quantised(unit: np.ndarray, threshold: float) -> np.ndarray:
    """Projections in cells, modulo 256: collisions are kept by wrapping, and
    what wrapping adds is ruled out by the verification."""
    z = unit @ directions(unit.shape[1])
    return (np.floor(z / _cell(unit.shape[1], threshold)).astype(np.int64) & 255).astype(np.uint8)


@lru_cache(maxsize=8)
def calibrated(dim: int, threshold: float) -> tuple[int, float]:
    """(collisions a near pair must reach, greatest distance on the first
    projection) over simulated pairs at the threshold."""
    if dim == 1:
        return PROJECTIONS - 1, 1e-6
    rng = np.random.default_rng(dim)
    fewest, widest = PROJECTIONS, 0.0
    for _ in range(-(-CALIBRATION // 20_000)):
        a = rng.standard_normal((20_000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        o = rng.standard_normal((20_000, dim))
        o -= (o * a).sum(axis=1, keepdims=True) * a
        o /= np.linalg.norm(o, axis=1, keepdims=True)
        b = threshold * a + np.sqrt(1 - threshold**2) * o
        d = quantised(a, threshold) - quantised(b, threshold) + np.uint8(CELLS)
        fewest = min(fewest, int((d <= 2 * CELLS).sum(axis=1).min()))
        widest = max(widest, float(np.abs((a - b) @ directions(dim)[:, 0]).max()))
    return fewest - 1, min(widest * 1.05, float(np.sqrt(2 - 2 * threshold)))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the first projection of the unit vector."""
    for b in batches:
        dims = np.diff(b.column("v").offsets.to_numpy())
        z = np.zeros(b.num_rows)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            m = matrix(b.column("v").take(pa.array(at)))
            z[at] = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ directions(int(d))[:, 0]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z)], [*b.schema.names, "z"])


def _star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked with each of n nodes by the links (a, b)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def _compare(threshold: float):
    """Rows of two blocks (side 0, 1) or of one block with itself to (c,
    links, root): the number of linked rows, copies counted, and a linked
    class standing for the linked group."""
    def run(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, dims = t.column("side").to_numpy(), t.column("dim").to_numpy()
        classes, copies = t.column("c").to_numpy(), t.column("copies").to_numpy()
        vectors = t.column("v").combine_chunks()
        alone = key[0] == key[1]
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            m = matrix(vectors.take(pa.array(at)))
            unit = m / np.linalg.norm(m, axis=1, keepdims=True)
            need, _ = calibrated(int(dim), threshold)
            q = np.ascontiguousarray(quantised(unit, threshold).T)
            left = np.flatnonzero(side[at] == 0)
            right = left if alone else np.flatnonzero(side[at] == 1)
            if not len(left) or not len(right):
                continue
            unit_r, q_r = unit[right], np.ascontiguousarray(q[:, right])
            pairs = []
            for lo in range(0, len(left), TILE):
                rows = left[lo:lo + TILE]
                count = np.zeros((len(rows), len(right)), np.uint8)
                for p in range(PROJECTIONS):
                    d = (q[p, rows] + np.uint8(CELLS))[:, None] - q_r[p][None, :]
                    count += d <= 2 * CELLS
                i, j = np.nonzero(count >= need)
                if alone:
                    i, j = i[rows[i] < right[j]], j[rows[i] < right[j]]
                if len(i) > 0.02 * count.size:
                    ok = (unit[rows] @ unit_r.T)[i, j] >= threshold
                else:
                    ok = np.concatenate([np.einsum("ij,ij->i", unit[rows[i[s:s + 50_000]]], unit_r[j[s:s + 50_000]])
                                         for s in range(0, len(i), 50_000)] or [np.zeros(0)]) >= threshold
                if ok.any():
                    pairs.append((rows[i[ok]], right[j[ok]]))
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs))
                copy = copies[at]
                links = np.bincount(a, copy[b], len(at)) + np.bincount(b, copy[a], len(at))
                root = _star(len(at), a, b)
                has = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes[at][has]), pa.array(links[has].astype(np.int64)), pa.array(classes[at][root[has]])],
                    ["c", "links", "root"])
    return by_key(["x", "y"], run)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``table``."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("vec_id"), F.when(finite(F.col(vector_col)), F.col(vector_col)).alias("v"))
    rows = rows.withColumn("v", F.when(norm(F.col("v")) > 0, F.transform("v", lambda x: x.cast("double"))))
    # equal vectors: one class, numbered by a written table's order
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    data = classes.select("c", "copies", "v", F.size("v").alias("dim"))
    schema = "c long, copies long, v array<double>, dim int"
    blocks = in_blocks(data.mapInArrow(_project, schema + ", z double"), ["dim", "z", "c"], block)

    # two numbers for every block of 4096 vectors
    spans = blocks.groupBy("block").agg(F.min("dim").alias("d0"), F.max("dim").alias("d1"), F.min("z").alias("z0"),
                                        F.max("z").alias("z1")).orderBy("block").collect()
    reach, last = [], 0
    for i, s in enumerate(spans):
        last = max(last, i)
        while last + 1 < len(spans) and _near(s, spans[last + 1], threshold):
            last += 1
        reach.append((s["block"], s["block"], spans[last]["block"]))
    if not reach:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    reach = spark.createDataFrame(reach, "block int, lo int, hi int")
    cols = ["c", "copies", "v", "dim"]
    work = reach.select(F.col("block").alias("x"), F.explode(F.sequence("lo", "hi")).alias("y"))
    left = blocks.join(work.withColumnRenamed("x", "block"), "block").select(
        F.col("block").alias("x"), "y", F.lit(0).alias("side"), *cols)
    right = blocks.join(work.where("x != y").withColumnRenamed("y", "block"), "block").select(
        "x", F.col("block").alias("y"), F.lit(1).alias("side"), *cols)
    found = materialize(left.unionByName(right).repartition("x", "y").sortWithinPartitions("x", "y")
                        .mapInArrow(_compare(threshold), "c long, links long, root long"), "near-links")

    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "c", "left").join(roots, F.col("c") == F.col("node"), "left").select(
        "v", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "c").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("v", "n_links", "component_id")
    out = rows.join(named, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _near(s, t, threshold: float) -> bool:
    """Whether block t (not before s) can hold a partner for one of s's vectors."""
    if t["d0"] > s["d1"]:
        return False
    if s["d0"] != s["d1"] or t["d0"] != t["d1"]:
        return True     # a block with several dimensions: compared in full
    return t["z0"] - s["z1"] <= calibrated(int(s["d0"]), threshold)[1]


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(seen) AS c FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
