"""Connected components of a link table, for operators 2 and 8.

Alternating large-star and small-star steps: every step gives each node's
neighbours its smallest neighbour, until the links are stars around the
smallest node of each component. Minima are partial sums before the shuffle and
joined back by key, so no node's neighbours are ever gathered. Every round is
a table in the shared folder; nothing but two numbers reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _fingerprint(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), any direction, to (node, root): the smallest node of
    its component for every linked node but the roots themselves."""
    e = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "links")
    before = _fingerprint(e)
    while before[0]:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
