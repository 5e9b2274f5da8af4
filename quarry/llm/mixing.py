"""Operator 10 [native]: mixing sources to target weights by weighted fair
queueing.

Every source holds its documents in one seeded random order (a hash of id and
text), repeated for up to ``repeats`` epochs. The virtual finish time of a
document is its source's words up to and including it, over the source's
target: sources advance at speeds proportional to their targets, and at time 1
each has given its target. All items are ordered by finish time and taken until
their words reach the budget, which is the sum of all sizes; the item that
crosses it is taken in part.

Running totals take two levels, so no source and no total order is one group:
within a source, ``BUCKETS`` ranges of the hash (a window within a bucket, the
bucket sums before it); over all items, a histogram of finish times, then one of
the single bin in which the budget runs out, and a window over what is left.

Defined results: null or empty text has size 0 and nothing taken; null sources
form one source, last in order; null ids and repeated rows count one row each
(rows equal in id and text follow each other, so reruns over other splits give the
same rows); no words at all gives targets and takes of 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BUCKETS = 1024
BINS = 4096            # per unit of finish time, and of the last bin
REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++"))


def source_targets(sized: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """One row per source: key, source_size, target. Sources beyond
    ``repeats`` times their size are capped there, the excess reshared: in the
    order of cap over weight the capped ones come first, so one pass of running
    sums over the sources finds the level."""
    sums = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("key")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    s = sums.withColumn("w", F.get(pick, (F.row_number().over(order) - 1) % len(weights)))
    s = s.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    s = s.withColumns({
        "left_words": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left_weight": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("level", F.col("left_words") / F.col("left_weight"))
    s = s.withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    # the first uncapped source in order has the final level
    first = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("w")).alias("at"), "key", "level"))).over(whole)
    level = F.coalesce(first["level"], F.lit(0.0))
    return s.select("key", "source_size", F.when(F.col("capped"), F.col("cap"))
                    .otherwise(F.least(F.col("cap"), level * F.col("w"))).alias("target"))


def _shuffled(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str,
              row_col: str | None = None) -> DataFrame:
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       words_in(F.col(text_col)).cast("long").alias("size"), row.alias("row"),
                       F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("t"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("t")))
    return rows.select(
        "doc_id", "size", "row",
        # by code point, null last: "0..." sorts before "1"
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("key"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"))


def _last_before(sums: DataFrame, budget: int) -> tuple[int, int] | None:
    """(bin in which the running total of ``n`` reaches ``budget``, total
    before it); None if it never does."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    row = sums.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") >= budget) \
        .select(F.min(F.struct("bin", F.col("upto") - F.col("n")))).first()[0]
    return (row[0], row[1]) if row is not None else None


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED,
        row_col: str | None = None) -> DataFrame:
    """(doc_id, row, size, source_size, target, taken): words the
    mix takes of every row, repeats counted. ``row``: of ``row_col`` (unique,
    not null), or numbered here."""
    sized = _shuffled(docs, id_col, text_col, source_col, seed, row_col)
    sized = materialize(sized.withColumn("bucket", F.shiftright("h", 50)), "sized", compact=True)   # h has 60 bits: 1024 buckets
    targets = source_targets(sized, weights, repeats)
    sums = sized.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "row") \
        .rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(inside)).join(ahead, ["key", "bucket"]) \
        .join(targets, "key").withColumn("upto", F.col("upto") + F.col("ahead"))
    placed = materialize(placed.select("doc_id", "row", "key", "h", "size", "source_size", "target", "upto"), "placed")
    finish = [F.when(F.col("target") > 0, (F.col("upto") + e * F.col("source_size")) / F.col("target"))
              for e in range(repeats)]
    items = placed.where("size > 0").select("row", "doc_id", "key", "h", "size", F.posexplode(F.array(*finish)).alias("epoch", "finish")) \
        .where("finish is not null")
    binned = items.select("*", F.floor(F.col("finish") * BINS).alias("bin")) \
        .withColumn("sub", F.floor((F.col("finish") * BINS - F.col("bin")) * BINS))
    budget = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = _last_before(binned.groupBy("bin").agg(F.sum("size").alias("n")), budget) if budget else None
    if cut is None:
        # nothing to take, or no more items than the budget: every item is taken
        taken = F.lit(0).cast("long") if not budget else F.col("size") * sum(f.isNotNull().cast("long") for f in finish)
        return placed.select("doc_id", "row", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).alias("taken"))
    last_bin, before = cut
    in_bin = binned.where(F.col("bin") == last_bin)
    last_sub, in_sub = _last_before(in_bin.groupBy(F.col("sub").alias("bin")).agg(F.sum("size").alias("n")), budget - before)
    rest = budget - before - in_sub
    order = Window.orderBy("finish", "key", "epoch", "h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    last = in_bin.where(F.col("sub") == last_sub) \
        .withColumn("gone", F.coalesce(F.sum("size").over(order), F.lit(0))) \
        .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.least("size", F.lit(rest) - F.col("gone")))).alias("part"))
    earlier_item = [F.coalesce((F.floor(f * BINS) < last_bin) | (F.floor(f * BINS) == last_bin) & (
        F.floor((f * BINS - F.floor(f * BINS)) * BINS) < last_sub), F.lit(False)).cast("long") for f in finish]
    whole = sum(earlier_item[1:], earlier_item[0])
    return placed.join(last, "row", "left").select(
        "doc_id", "row", "size", "source_size", "target",
        (F.col("size") * whole + F.coalesce("part", F.lit(0))).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce('0' || source, '1') AS key,
         ('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, (((row_number() OVER (ORDER BY key)) - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM s),
v AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / ((SELECT sum(w) FROM w)
                 - coalesce(sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w),
f AS (SELECT level FROM v WHERE NOT level * w > cap ORDER BY cap / w, key LIMIT 1),
t AS (SELECT key, source_size, CASE WHEN level * w > cap THEN cap
                                    ELSE least(cap, (SELECT level FROM f) * w) END AS target FROM v),
p AS (SELECT d.*, t.source_size, t.target,
             sum(size) OVER (PARTITION BY key ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t USING (key)),
i AS (SELECT doc_id, key, h, size, e, (upto + e * source_size) / target AS finish
      FROM p, (VALUES (0), (1), (2)) AS x(e) WHERE size > 0 AND target > 0),
c AS (SELECT doc_id, greatest(0, least(size, (SELECT sum(size) FROM d) - coalesce(sum(size) OVER (
             ORDER BY finish, key, e, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part FROM i),
g AS (SELECT doc_id, sum(part) AS taken FROM c GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM p LEFT JOIN g USING (doc_id)
"""
