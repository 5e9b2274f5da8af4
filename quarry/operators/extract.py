"""Passages of a documents table, by input type.

``.html`` -> T1/T2 then T3-T7 ("paragraphs"); ``.txt`` -> T8/T9 ("stanzas");
``.pdf`` -> page text through S3, T7 and T10 ("chunks"). Any other type is
rejected with a reason (``.htm`` too), not silently dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html as H
from . import passages as P
from .packing import pack_passage_rows

SUPPORTED = {".html": "paragraphs", ".txt": "stanzas", ".pdf": "chunks"}


def extract_passages(documents: DataFrame, page_text: DataFrame | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """``documents(doc_id, format, content)`` (+ optional ``page_text(doc_id,
    page_no, text)`` for PDFs) -> ``(passages(doc_id, passage_no,
    content_type, passage_key, text), rejects(doc_id, reason))``. ``passage_key``
    (``12.html:3``) is unique where one id stands for files of several types."""
    fmt = F.lower("format")
    html = H.with_html_text(documents.where(fmt == ".html").select("doc_id", "content"),
                            "content", "__t").select("doc_id", P.paragraphs("__t").alias("ps"))
    txt = documents.where(fmt == ".txt").select("doc_id", P.stanzas("content").alias("ps"))
    parts = [P.number_passages(html, "ps", ["doc_id"]).withColumn("content_type", F.lit("paragraphs")),
             P.number_passages(txt, "ps", ["doc_id"]).withColumn("content_type", F.lit("stanzas"))]
    if page_text is not None:
        pdf_ids = documents.where(fmt == ".pdf").select("doc_id")
        pages = page_text.join(pdf_ids, "doc_id", "left_semi")
        chunks = pack_passage_rows(P.kept_paragraphs(P.reflow_pages(pages)), "para_no")
        parts.append(chunks.withColumn("content_type", F.lit("chunks")))
    passages = parts[0]
    for p in parts[1:]:
        passages = passages.unionByName(p)
    suffix = F.create_map(*[F.lit(x) for fmt_kind in SUPPORTED.items() for x in reversed(fmt_kind)])
    passages = passages.select(
        "doc_id", F.col("passage_no").cast("int").alias("passage_no"), "content_type",
        F.concat(F.col("doc_id").cast("string"), suffix[F.col("content_type")], F.lit(":"), F.col("passage_no").cast("string"))
        .alias("passage_key"), "text")
    handled = list(SUPPORTED) if page_text is not None else [".html", ".txt"]
    rejects = documents.where(~fmt.isin(*handled) | fmt.isNull()).select(
        "doc_id", F.concat(F.lit("unsupported file type: "), F.coalesce(fmt, F.lit(""))).alias("reason"))
    return passages, rejects
