"""Resume state: R1-R4.

Progress is the set of finished passage numbers per document. Stored as
rows; ranges ``[lo, hi]`` are only an export form (parquet already run-length
encodes sorted numbers).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import number_by_rank


def expand_ranges(ranges: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi",
                  out: str = "passage_no") -> DataFrame:
    """Each inclusive ``[lo, hi]`` (a single number has lo = hi) becomes
    its numbers; generated inside the row, no shuffle."""
    return ranges.select(*keys, F.explode(F.sequence(F.col(lo), F.col(hi))).alias(out))


def compress_ranges(numbers: DataFrame, keys: Sequence[str], num: str = "passage_no",
                    lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Distinct numbers merged into maximal runs of consecutive values.

    Gaps and islands: ``n - rank(n)`` is constant along a run. Ranks come from
    blocks of the sorted numbers (no single task per key, however sparse the
    numbers are) and each island is a partial+final min/max aggregate, so one
    huge island is combined map-side.
    """
    keys = list(keys)
    distinct = numbers.select(*keys, F.col(num).cast("long").alias("__n")).distinct()
    ranked = number_by_rank(distinct, keys, ["__n"], "__rank")
    return ranked.groupBy(*keys, (F.col("__n") - F.col("__rank")).alias("__island")) \
        .agg(F.min("__n").alias(lo), F.max("__n").alias(hi)).drop("__island")


def pending(passages: DataFrame, completed: DataFrame,
            keys: Sequence[str] = ("doc_id", "passage_no")) -> DataFrame:
    """Passages whose key is not completed (a left anti join; Spark
    broadcasts the completed side when its runtime size allows)."""
    return passages.join(completed.select(*keys), list(keys), "left_anti")


def completed_from_results(results: DataFrame,
                           keys: Sequence[str] = ("doc_id", "passage_no")) -> DataFrame:
    """R2: the completed set is the keys present in the results table."""
    return results.select(*keys).distinct()


RANGE_BUCKET = 65536


def pending_by_ranges(passages: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("doc_id",),
                      num: str = "passage_no", lo: str = "lo", hi: str = "hi",
                      bucket: int = RANGE_BUCKET) -> DataFrame:
    """R1 against stored ranges ``[lo, hi]`` without writing out their numbers: a
    range stands in every bucket of ``bucket`` numbers it touches, a passage meets the
    ranges of its own bucket (an interval anti join within (keys, bucket)).
    Ranges whose ``lo`` exceeds ``hi`` hold nothing."""
    keys = list(keys)
    at = lambda c: F.floor(F.col(c) / bucket).cast("long")
    spread = ranges.where(F.col(lo) <= F.col(hi)).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col(lo).alias("__lo"), F.col(hi).alias("__hi"),
        F.explode(F.sequence(at(lo), at(hi))).alias("__bucket"))
    meets = at(num) == F.col("__bucket")
    for k in keys:
        meets = meets & (F.col(k) == F.col(f"__{k}"))
    inside = (F.col(num) >= F.col("__lo")) & (F.col(num) <= F.col("__hi"))
    return passages.join(spread, meets & inside, "left_anti")


def mark_completed(results: DataFrame, path: str, run_id: int, keys: Sequence[str] = ("doc_id",),
                   num: str = "passage_no") -> None:
    """R2: store the passages of ``results`` as completed ranges of a run, next to
    those stored before (ranges of different calls may touch or overlap)."""
    compress_ranges(results.select(*keys, num), keys, num).withColumn("run_id", F.lit(int(run_id))) \
        .write.mode("append").partitionBy("run_id").parquet(path)
