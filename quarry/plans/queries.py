"""Named query plans over the driver tables.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame built
from the library operators; ``__spark_entry__.queries()`` registers them and
``quarry.plans.oracle`` holds the matching DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade as C
from ..operators import extract as X
from ..operators import html as H
from ..operators import jobs as J
from ..operators import progress as R
from ..operators.prompts import build_prompt
from ..operators import passages as P
from ..operators.packing import pack_passage_rows
from ..operators import reports as K
from ..operators import sinks as S
from ..operators import verdicts as V
from ..session import materialize, new_folder
from ..sources import table
from .replay import ANSWERS, SAMPLES, pick
from .rules import three_judges, two_judges


# ------------------------------------------------------------- text path
def conversation_stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per conversation (turns joined by a blank line,
    in turn order) split into stanzas; computed per turn and numbered across
    turns, so a long conversation is never gathered into one row."""
    conv = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", P.stanzas(F.coalesce(F.col("text"), F.lit(""))).alias("st"))
    return P.passages_from_parts(conv, "conv_id", "turn", "st")


def txt_stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_stanzas(spark, sf_dir)


def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3-T7, T11 over ``documents``: row-local, no shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", P.paragraphs("text").alias("ps"))
    return P.number_passages(docs, "ps", ["doc_id"]) \
        .select("doc_id", F.col("passage_no").cast("int").alias("passage_no"), "text")


def paragraphs_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_paragraphs(spark, sf_dir)


# ------------------------------------------------------------ verdict path
def _replayed(spark: SparkSession, sf_dir: str, steps: dict[str, list]) -> DataFrame:
    """One row per ``labels.doc_id`` and each combination of ``steps``,
    generated in the row (explode of a literal array, no join)."""
    df = table(spark, sf_dir, "labels").select("doc_id")
    for name, values in steps.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def parse_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2-M4 over replayed answers; model 1 is the final (JSON) model."""
    rows = _replayed(spark, sf_dir, {"model_idx": [0, 1]})
    rows = rows.withColumn("raw", pick(ANSWERS, F.col("doc_id") * 7 + F.col("model_idx") * 3))
    rows = V.with_verdict(rows, "raw", F.col("model_idx") == 1, "v")
    v = F.col("v")
    return rows.select("doc_id", "model_idx", "raw", v["clear"].alias("clear"),
                       v["label"].alias("label"), v["confidence"].alias("confidence"),
                       v["explanation"].alias("explanation"))


def resolve_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: three replayed tries per (document, model); first clear try wins."""
    rows = _replayed(spark, sf_dir, {"model_idx": [0, 1], "attempt": [1, 2, 3]})
    rows = rows.withColumn("raw", pick(ANSWERS, F.col("doc_id") * 5 + F.col("model_idx") * 11
                                       + F.col("attempt") * 13))
    rows = V.with_verdict(rows, "raw", F.col("model_idx") == 1, "v")
    return V.resolve_attempts(rows, ["doc_id", "model_idx"])


def vote_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + M7: five replayed samples per asked label, shares, vote."""
    rows = _replayed(spark, sf_dir, {"label": ["1", "0"], "sample_no": [1, 2, 3, 4, 5]})
    rows = rows.withColumn("raw", pick(SAMPLES, F.col("doc_id") * 3 + F.col("sample_no") * 5
                                       + F.when(F.col("label") == "1", 7).otherwise(0)))
    return V.resolve_by_vote(V.label_shares(rows, ["doc_id"]))


def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 (+T2 fallback, F4) then T3-T7, T11 over ``pages``: the paragraph
    texts are joined by blank lines and split again, as the rules compose."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    text = H.with_html_text(pages, "html", "page_text")
    docs = text.select("doc_id", P.paragraphs("page_text").alias("ps"))
    return P.number_passages(docs, "ps", ["doc_id"]) \
        .select("doc_id", F.col("passage_no").cast("int").alias("passage_no"), "text")


def html_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with their ``<p>`` elements renamed, so that none has a
    paragraph and the full text of each is taken."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.regexp_replace("html", r"(?i)<(/?)p\b", "<$1div").alias("html"))
    docs = H.with_html_text(pages, "html", "page_text").select("doc_id", P.paragraphs("page_text").alias("ps"))
    return P.number_passages(docs, "ps", ["doc_id"]) \
        .select("doc_id", F.col("passage_no").cast("int").alias("passage_no"), "text")


def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's kept paragraphs packed into >= 1600-character
    chunks (one fold per document row, no shuffle)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", P.pack_chunks(P.paragraphs("text")).alias("chunks"))
    return P.number_passages(docs, "chunks", ["doc_id"]) \
        .select("doc_id", F.col("passage_no").cast("int").alias("passage_no"), "text")


PAGE_WIDTH = 700   # characters per synthetic page when documents stand in for PDF page text


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a blank line behind every sentence, cut into fixed-width
    pages ``(doc_id, page_no, text)``: the page-text input an extractor would
    give (S3 input), with paragraphs inside pages and over their ends."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit(". "), F.lit(".\n \n")).alias("text"))
    return docs.select("doc_id", F.posexplode(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PAGE_WIDTH}}}+"), F.lit(0))).alias("page_no", "text"))


def reflow_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: page texts fused in page order, lines reflowed into paragraphs."""
    return P.reflow_pages(page_text(spark, sf_dir))


def pdf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + T7 + T10: the whole page-text path to numbered chunks; packing
    runs on passage rows in bounded blocks (no document is gathered)."""
    return pack_passage_rows(P.kept_paragraphs(P.reflow_pages(page_text(spark, sf_dir))), "para_no")


def extract_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One documents table of mixed types -- pages as HTML, documents as
    plain text and (through their page text) as PDF -- dispatched by type."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit(".html").alias("format"), F.col("html").alias("content"))
    docs = table(spark, sf_dir, "documents")
    txt = docs.select("doc_id", F.lit(".txt").alias("format"), F.col("text").alias("content"))
    pdf = docs.select("doc_id", F.lit(".pdf").alias("format"), F.lit(None).cast("string").alias("content"))
    passages, _ = X.extract_passages(pages.unionByName(txt).unionByName(pdf), page_text(spark, sf_dir))
    return passages


# ----------------------------------------------------------------- cascade
KEYS = ["doc_id", "passage_no"]


def cascade_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 (+M5-M7, M9, M10) with two rule judges over conversation stanzas:
    one projection over the passages, later judges only on accepted rows."""
    return C.cascade_rules(conversation_stanzas(spark, sf_dir), two_judges(), KEYS)


def ordered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's results by document and passage."""
    return K.order_by_passage(cascade_rule(spark, sf_dir), KEYS)


def cascade_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: how document paragraphs end in a three-judge cascade, by trail."""
    res = C.cascade_rules(document_paragraphs(spark, sf_dir), three_judges(), KEYS)
    return res.groupBy("cascade_info", "status").agg(
        F.count(F.lit(1)).alias("passages"),
        F.count(F.when(F.col("label") == "1", True)).alias("found"))


def _run_results(spark: SparkSession, sf_dir: str, carry=()) -> DataFrame:
    return C.cascade_rules(conversation_stanzas(spark, sf_dir), two_judges(), KEYS,
                           carry=list(carry)).withColumn("run_id", F.lit(0))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted passages numbered per run, with the quote line and
    the detailed-report block."""
    # the verdicts are written before the filter, which would repeat the judges' expressions;
    # only accepted passages keep their text
    results = _run_results(spark, sf_dir, carry=["text"])
    results = results.withColumn("text", F.when(F.col("label") == "1", F.col("text")))
    return _report_rows(materialize(results, "verdicts").where(F.col("label") == "1"))


def _report_rows(found: DataFrame) -> DataFrame:
    numbered = K.number_findings(found)
    return numbered.select(
        "run_id", "doc_id", "passage_no", "finding_no", "confidence", "explanation",
        K.raw_quote("text").alias("raw_quote"),
        K.detail_entry("finding_no", "passage_no", "confidence", "explanation", "text")
        .alias("detail"))


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K4 written and read again: the results of two runs (of two judges, and of
    the first alone) are appended, each twice, and their reports written run
    by run; every line of the report files with how often it occurs."""
    base = new_folder(spark, "stored-reports")
    stanzas = conversation_stanzas(spark, sf_dir)
    for run_id, judges in ((0, two_judges()), (1, two_judges()[:1])):
        results = C.cascade_rules(stanzas, judges, KEYS, carry=["text"]).withColumn("run_id", F.lit(run_id))
        for _ in range(2):
            S.write_results(results, f"{base}/results")
    stored = spark.read.parquet(f"{base}/results")
    for run_id in (0, 1):
        own = stored.where(F.col("run_id") == run_id)
        S.write_reports(_report_rows(own.where(F.col("label") == "1")), K.run_totals(own), base)
    files = [spark.read.option("lineSep", "\n").text(f"{base}/{name}").withColumn("report", F.lit(name))
             for name in ("raw_quotes", "detailed_results")]
    return files[0].unionByName(files[1]).groupBy("run_id", "report", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A2 over the cascade results."""
    return K.run_totals(_run_results(spark, sf_dir))


def recent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight finished passages (in passage order), oldest first."""
    res = _run_results(spark, sf_dir)
    return K.recent(res, ["doc_id", "passage_no"]).select(
        "doc_id", "passage_no", "label", "confidence", "cascade_info")


def next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next free run id given the existing ids (here ``labels.doc_id``)."""
    runs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_id"))
    return K.next_run_id(runs)


# ------------------------------------------------------------------ resume
def _label_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("set_id"))


def completed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (gapped) ``labels.doc_id`` set as maximal consecutive runs."""
    return R.compress_ranges(_label_set(spark, sf_dir), ["set_id"], "doc_id").select("lo", "hi")


def expanded_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges ``[doc_id, doc_id + quality + 2*toxic]`` back to numbers."""
    ranges = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("doc_id").alias("lo"),
        (F.col("doc_id") + F.col("quality") + 2 * F.col("toxic")).alias("hi"))
    return R.expand_ranges(ranges, ["doc_id"], out="n")


def _completed_stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of an earlier session: for each labelled id, passages
    ``0 .. quality + toxic`` of that conversation are done."""
    ranges = table(spark, sf_dir, "labels").select(
        "doc_id", F.lit(0).alias("lo"), (F.col("quality") + F.col("toxic")).alias("hi"))
    return R.expand_ranges(ranges, ["doc_id"]).select(
        "doc_id", F.col("passage_no").cast("int").alias("passage_no"))


def pending_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation stanzas not completed yet."""
    return R.pending(conversation_stanzas(spark, sf_dir), _completed_stanzas(spark, sf_dir))


def pending_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 against stored ranges, never written out as numbers."""
    ranges = table(spark, sf_dir, "labels").select(
        "doc_id", F.lit(0).alias("lo"), (F.col("quality") + F.col("toxic")).alias("hi"))
    return R.pending_by_ranges(conversation_stanzas(spark, sf_dir), ranges)


def resumed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 + S6 + R1: the passages an earlier session judged are stored as ranges
    of run 3, read again and left out."""
    passages = conversation_stanzas(spark, sf_dir)
    judged = passages.join(_completed_stanzas(spark, sf_dir), KEYS, "left_semi")
    path = new_folder(spark, "progress")
    R.mark_completed(judged, path, 3)
    R.mark_completed(judged.where("passage_no > 0"), path, 3)      # ranges of two sessions overlap
    R.mark_completed(passages, path, 4)                            # another run's do not count
    stored = spark.read.parquet(path).where("run_id = 3")
    return R.pending_by_ranges(passages, stored)


def progress_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + A4 per conversation: total, completed, remaining, resume point."""
    return K.progress(conversation_stanzas(spark, sf_dir), _completed_stanzas(spark, sf_dir))


# -------------------------------------------------------------------- jobs
MODELS = ["screen", "lengthy", "verify"]


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per document source; fields chosen by rule so that every
    validation branch occurs."""
    src = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.min("lang").alias("lang"), F.min("n_chars").alias("shortest"))
    lang = F.col("lang")
    return src.select(
        F.col("source").alias("job_id"),
        F.when(lang == "de", F.array(F.lit("screen"), F.lit("verify")))
         .when(lang == "en", F.array(*[F.lit(m) for m in MODELS]))
         .when(lang == "es", F.array(F.lit("screen"), F.lit("oracle-x")))
         .otherwise(F.array().cast("array<string>")).alias("model_names"),
        F.concat("source", F.when(lang == "de", ".pdf").when(lang == "en", ".txt")
                 .when(lang == "es", ".HTML").otherwise(".htm")).alias("target_file"),
        F.when(F.col("shortest") < 10, F.lit("  "))
         .otherwise(F.concat(F.lit("a sentence in "), lang)).alias("search_criteria"))


def validate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7 over the derived jobs."""
    return J.validate_jobs(_jobs(spark, sf_dir), MODELS).select("job_id", "valid", "problems")


def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 + R5: document paragraphs meet the valid job aimed at their
    source; both prompt forms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", P.paragraphs("text").alias("ps"))
    paras = P.number_passages(docs, "ps", ["doc_id", "source"])
    jobs = J.validate_jobs(_jobs(spark, sf_dir), MODELS).where("valid") \
        .select("job_id", "search_criteria")
    joined = J.attach_jobs(paras, jobs, "source", "job_id")
    return joined.select(
        "doc_id", F.col("passage_no").cast("int").alias("passage_no"), "job_id",
        build_prompt(F.col("search_criteria"), F.col("text"), False).alias("prompt_short"),
        build_prompt(F.col("search_criteria"), F.col("text"), True).alias("prompt_final"))


def _language_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs aimed at the documents of a language, with judge lists of their own;
    English texts have two."""
    lists = {"de": [["screen", "verify"]], "en": [["screen", "lengthy", "verify"], ["lengthy", "screen"]],
             "es": [["verify"]], "fr": [["lengthy", "verify"]]}
    found = table(spark, sf_dir, "documents").select("lang").distinct()
    choice = F.lit(None).cast("array<array<string>>")
    for lang, names in lists.items():
        choice = F.when(F.col("lang") == lang, F.array(*[F.array(*[F.lit(n) for n in x]) for x in names])).otherwise(choice)
    return found.select("lang", F.posexplode(choice).alias("pos", "model_names")).select(
        F.concat("lang", F.lit("-"), F.col("pos").cast("string")).alias("job_id"), "model_names",
        F.col("lang").alias("target_file"), F.concat(F.lit("a sentence in "), "lang").alias("search_criteria"))


def job_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 + M8: every passage under each job aimed at its document; stage k asks the
    judge that the job names at place k."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", P.paragraphs("text").alias("ps"))
    paras = P.number_passages(docs, "ps", ["doc_id", "lang"]).withColumn("passage_no", F.col("passage_no").cast("int"))
    jobs = _language_jobs(spark, sf_dir)
    joined = J.attach_jobs(paras, jobs, "lang")
    return C.cascade_jobs(joined, three_judges(), ["job_id", *KEYS], J.longest_cascade(jobs))


REGISTRY = {
    "txt_stanzas": txt_stanzas,
    "paragraphs_fallback": paragraphs_fallback,
    "parse_verdicts": parse_verdicts,
    "resolve_attempts": resolve_attempts,
    "vote_resolution": vote_resolution,
    "cascade_rule": cascade_rule,
    "ordered_results": ordered_results,
    "cascade_trail": cascade_trail,
    "findings": findings,
    "stored_reports": stored_reports,
    "run_totals": run_totals,
    "recent_results": recent_results,
    "next_run": next_run,
    "completed_ranges": completed_ranges,
    "expanded_ranges": expanded_ranges,
    "pending_passages": pending_passages,
    "pending_by_ranges": pending_by_ranges,
    "resumed_passages": resumed_passages,
    "progress_state": progress_state,
    "validate_jobs": validate_jobs,
    "build_prompts": build_prompts,
    "job_cascade": job_cascade,
    "pack_chunks": pack_chunks,
    "reflow_pages": reflow_pages,
    "pdf_chunks": pdf_chunks,
    "html_paragraphs": html_paragraphs,
    "html_fulltext": html_fulltext,
    "extract_passages": extract_passages,
}

FLAGSHIP = findings
