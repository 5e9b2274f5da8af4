"""Documents from files and completed passages from results.

Whole files are read as bytes: one row per file, its path, a stable 64-bit id
from the path. Bytes that are not valid UTF-8 go to the reject side (a file that
holds U+FFFD itself is valid); PDF files keep a null content, as their text comes
as page text. Text-mode newline translation is applied (CRLF and CR become LF).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import file_suffix

DOCUMENT_SCHEMA = "doc_id long, path string, format string, content string"


def read_documents(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """S1 + S2: ``(documents, rejects)``; documents has ``doc_id, path,
    format`` (lower-cased suffix, F10) and ``content``."""
    raw = spark.read.format("binaryFile").load(paths) \
        .select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("content")) \
        .withColumn("format", file_suffix("path"))
    is_text = F.col("format") != ".pdf"
    bad = is_text & ~F.is_valid_utf8("content")
    docs = raw.where(~bad).select(F.xxhash64("path").alias("doc_id"), "path", "format",
                                  F.when(is_text, F.regexp_replace("content", "\r\n?", "\n")).alias("content"))
    return docs, raw.where(bad).select(F.xxhash64("path").alias("doc_id"), "path", F.lit("invalid utf-8").alias("reason"))


def is_missing(e: AnalysisException) -> bool:
    """Whether a read failed because the table is not there yet: no folder, or
    one whose files were all removed."""
    return any(m in str(e) for m in ("PATH_NOT_FOUND", "Path does not exist", "UNABLE_TO_INFER_SCHEMA"))


def read_completed(spark: SparkSession, results_path: str, run_id: int,
                   keys=("doc_id", "passage_no")) -> DataFrame:
    """The keys already finished in one run. A missing results table means
    nothing is done; any other read failure is raised (not silently reset)."""
    try:
        res = spark.read.parquet(results_path)
    except AnalysisException as e:
        if is_missing(e):
            return spark.createDataFrame([], "doc_id long, passage_no int")
        raise
    return res.where(F.col("run_id") == run_id).select(*keys).distinct()
