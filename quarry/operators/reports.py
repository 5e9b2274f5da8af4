"""Findings, totals and monitoring views: W1-W4, A1-A4, K2-K4.

Numbers are derived from the results table, never kept as counters, so they
cannot drift across sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import number_by_rank

# Layout of the text reports.
DETAIL_HEADER = "Matching Paragraphs Found\n" + "=" * 50 + "\n\n"
DETAIL_RULE = "-" * 60
SUMMARY_RULE = "=" * 50
RECENT_COUNT = 8


def number_findings(findings: DataFrame, run_col: str = "run_id", doc_col: str = "doc_id",
                    pos_col: str = "passage_no", out: str = "finding_no") -> DataFrame:
    """1-based finding number per run, in (document, passage) order.

    A run is one key holding every finding, so ``row_number() over
    (partition by run)`` would run in one task. The keys alone are numbered, in
    blocks of the global order (``sequence.number_by_rank``: hashed document ids are
    as good as dense ones), and join back; the text never goes through a window.
    """
    keys = [run_col, doc_col, pos_col]
    numbered = number_by_rank(findings.select(*keys), [run_col], [doc_col, pos_col], out)
    return findings.join(numbered.withColumn(out, F.col(out) + 1), keys)


def raw_quote(text) -> Column:
    """K2: the whole passage in double quotes, no escaping."""
    return F.concat(F.lit('"'), F.col(text) if isinstance(text, str) else text, F.lit('"'))


def detail_entry(finding_no, passage_no, confidence, explanation, text) -> Column:
    """K3: one block of the detailed report; null when there is no
    explanation (such findings appear in the quotes only)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    block = F.concat(
        F.lit("Finding #"), c(finding_no).cast("string"),
        F.lit(" (Paragraph "), (c(passage_no) + 1).cast("string"),
        F.lit(", Confidence: "), F.format_string("%.2f", c(confidence)), F.lit(")\n"),
        F.lit(DETAIL_RULE + "\n"),
        F.lit("Explanation: "), c(explanation), F.lit("\n\n"),
        c(text), F.lit("\n\n"))
    return F.when(F.length(c(explanation)) > 0, block)


def run_totals(results: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A1 + A2: processed (errors included), found, success rate in percent
    (DOUBLE, unrounded; null when nothing was processed)."""
    agg = results.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count(F.when(F.col("label") == "1", True)).alias("found"))
    return agg.withColumn(
        "success_rate",
        F.when(F.col("processed") > 0,
               F.col("found").cast("double") * 100.0 / F.col("processed")))


def summary_text(totals: DataFrame) -> DataFrame:
    """K4: the completion block of the detailed report, one row per run.
    Rendering is the only place a rate is rounded (one decimal)."""
    rate = F.when(F.col("success_rate").isNotNull(),
                  F.concat(F.lit("Success rate: "), F.format_string("%.1f", "success_rate"),
                           F.lit("%\n"))).otherwise(F.lit(""))
    return totals.select(
        *[c for c in totals.columns],
        F.concat(F.lit("\n" + SUMMARY_RULE + "\nPROCESSING COMPLETE\n" + SUMMARY_RULE + "\n"),
                 F.lit("Total paragraphs processed: "), F.col("processed").cast("string"),
                 F.lit("\nMatches found: "), F.col("found").cast("string"), F.lit("\n"),
                 rate).alias("summary"))


def remaining(passages: DataFrame, pending: DataFrame, keys=("doc_id",)) -> DataFrame:
    """A3: total and remaining passages per document."""
    keys = list(keys)
    tot = passages.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    left = pending.groupBy(*keys).agg(F.count(F.lit(1)).alias("remaining"))
    return tot.join(left, keys, "left").fillna(0, ["remaining"])


def resume_state(completed: DataFrame, keys=("doc_id",), num_col: str = "passage_no") -> DataFrame:
    """A4: how many passages are done and where to resume (highest + 1)."""
    return completed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("completed"),
        (F.max(num_col) + 1).alias("resume_from"))


def progress(passages: DataFrame, done: DataFrame, keys=("doc_id", "passage_no"), group=("doc_id",),
             num_col: str = "passage_no") -> DataFrame:
    """A3 + A4 in one pass: total, completed, remaining and resume point of each
    document, from one left join of the passages with the completed keys."""
    keys, group = list(keys), list(group)
    flagged = passages.select(*keys).join(done.select(*keys).distinct().withColumn("__done", F.lit(True)), keys, "left")
    return flagged.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.count("__done").alias("completed"),
        F.count(F.when(F.col("__done").isNull(), 1)).alias("remaining"),
        (F.max(F.when(F.col("__done"), F.col(num_col))) + 1).alias("resume_from"))


def order_by_passage(results: DataFrame, keys=("doc_id", "passage_no")) -> DataFrame:
    """Results by document and passage (a global range sort, no single task)."""
    return results.orderBy(*keys)


def next_run_id(runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """One past the highest existing run id, 0 when there is none."""
    return runs.agg((F.coalesce(F.max(run_col).cast("long"), F.lit(-1)) + 1).alias("next_run_id"))


def recent(results: DataFrame, order_cols, n: int = RECENT_COUNT) -> DataFrame:
    """The last ``n`` finished rows, oldest first (a top-k: each task keeps
    its own n, the driver merges n per task)."""
    cols = [F.col(c) for c in order_cols]
    return results.orderBy(*[c.desc() for c in cols]).limit(n).orderBy(*cols)
