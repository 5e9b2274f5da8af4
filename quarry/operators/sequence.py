"""Ordered numbering and running totals that survive hot keys.

``row_number() over (partition by k order by o)`` sends every row of one key
to one task. When a single document, conversation or run holds a large share
of all rows, that task does that share of the work alone. The helpers here
split each key's order range into blocks:

* inside a block the window is bounded (at most ``block`` rows when the order
  values are distinct integers);
* block totals are a partial+final aggregate (map-side combine);
* the running total *of block totals* is the same problem on a table
  ``block`` times smaller, solved recursively for ``levels`` levels;
* block offsets join back on ``(key, block)``, which spreads a hot key over
  as many shuffle partitions as it has blocks.

With the default ``block=65536, levels=1`` and dense order values (positions,
page numbers) a key holding 3e11 rows puts about 4.6e6 block totals in one sorted
window task (tens of MB), every other task holds at most 65536 rows. ``levels=2``
adds another level for keys far beyond that, at the price of a larger plan.

Blocks by value need dense values. For sparse ones (hashed ids) ``rank_blocks`` cuts
by *rank*: the slim rows are range-partitioned by key and order and written
with their partition as block, so a key has at most as many blocks as there are
partitions, whatever its values. ``number_by_rank`` numbers rows that way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str,
                  out: str, block: int = 65536, levels: int = 1,
                  inclusive: bool = False) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same ``keys`` with a
    smaller ``order`` (plus the row itself when ``inclusive``).

    ``order`` must be an integral column, distinct within a key.
    """
    keys = list(keys)
    if levels <= 0:
        frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(frame), F.lit(0)).cast("long"))

    blk = f"__blk{levels}"
    inner = f"__in{levels}"
    tot = f"__tot{levels}"
    off = f"__off{levels}"
    base = df.withColumn(blk, F.floor(F.col(order) / F.lit(block)).cast("long"))
    frame = Window.partitionBy(*keys, blk).orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    d = base.withColumn(inner, F.coalesce(F.sum(value).over(frame), F.lit(0)))
    totals = base.groupBy(*keys, blk).agg(F.sum(value).alias(tot))
    totals = running_total(totals, keys, blk, tot, off, block, levels - 1)
    d = d.join(totals.select(*keys, blk, off), [*keys, blk], "inner")
    return d.withColumn(out, (F.col(off) + F.col(inner)).cast("long")).drop(blk, inner, off)


def number_within(df: DataFrame, keys: Sequence[str], order: str, out: str,
                  block: int = 65536, levels: int = 1) -> DataFrame:
    """0-based position of each row among the rows of its key, by ``order``."""
    d = df.withColumn("__one", F.lit(1))
    return running_total(d, keys, order, "__one", out, block, levels).drop("__one")


def rank_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "__blk") -> DataFrame:
    """``df`` (slim rows) as a written table with its block: the partition of a
    range partitioning by ``keys`` and ``order``. Blocks follow the order."""
    at = [*keys, *order]
    return materialize(df.repartitionByRange(*at).sortWithinPartitions(*at).withColumn(out, F.spark_partition_id()), "rank-blocks")


def number_by_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based position of each row among the rows of its key, by ``order``
    (distinct within a key, values of any spread)."""
    keys, blk = list(keys), "__blk"
    d = rank_blocks(df, keys, order, blk)
    # at most one row for each key and partition
    before = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    ahead = d.groupBy(*keys, blk).agg(F.count(F.lit(1)).alias("__n")) \
        .select(*keys, blk, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy(*keys, blk).orderBy(*order)) - 1
    return d.withColumn("__in", inside).join(ahead, [*keys, blk]) \
        .withColumn(out, (F.col("__in") + F.col("__ahead")).cast("long")).drop("__in", "__ahead", blk)
