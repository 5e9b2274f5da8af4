"""Shared by operators 1 and 2: cleaning and packing vectors in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 4096


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds only finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def matrix(column: pa.Array) -> np.ndarray:
    """List column to float64 rows; shorter rows are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def in_blocks(df: DataFrame, order: list, size: int = BLOCK) -> DataFrame:
    """``df`` in the given global order as a written table with its ``block``: the
    partition of a range partitioning of about ``size`` rows each."""
    n = df.count()
    ranged = df.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("block", F.spark_partition_id()), "blocks")


def by_key(keys: list[str], run: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]]):
    """A mapInArrow function over rows sorted by ``keys``: ``run`` gets each
    key's rows as one table. For keys whose rows are bounded, as blocks are."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, rows = None, []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in keys]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(new).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                k = tuple(c[lo] for c in cols)
                if k != open_key and rows:
                    yield from run(open_key, pa.Table.from_batches(rows))
                    rows = []
                open_key = k
                rows.append(b.slice(lo, hi - lo))
        if rows:
            yield from run(open_key, pa.Table.from_batches(rows))
    return stream
