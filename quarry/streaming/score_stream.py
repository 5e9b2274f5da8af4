"""Score documents as they arrive, never judging a passage twice.

``readStream`` over a folder of document files -> per-row passage shaping, by the
documents' type if they have one (S4) -> ``dropDuplicates`` on the passage keys ->
``foreachBatch`` that judges what is new and writes it as the folder of its batch.

What was seen is the keyed state of ``dropDuplicates`` in the stream's checkpoint: a
micro-batch reads the state of its own keys, not the results so far. A batch that is
replayed after a failure writes the same folder again. Every checkpoint has a stream
id of its own; results that other streams of the run have stored before (a lost
checkpoint, a second source) are left out by an anti join with their keys only.

Model judges run as a staged cascade of the batch's own (its tables lie below the
stream's and batch's folder), so a replayed batch asks nothing again and a batch
never reads the answers of others.

Page text (S3) is not offered here: it needs every page of a document, which
a file stream does not promise to deliver together.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import cascade as C
from ..operators import html as H
from ..operators import passages as P
from ..sources.files import is_missing

KEYS = ["doc_id", "passage_no"]


def shape_passages(docs: DataFrame, kind: str, id_col: str = "doc_id",
                   text_col: str = "text", format_col: str = "format") -> DataFrame:
    """Per-row passage extraction for a stream (or a batch) of whole
    documents: ``kind`` is 'txt' (stanzas), 'text' (paragraphs), 'html', or
    'dispatch' (by the suffix in ``format_col``: '.html', '.txt'; other types give
    no passages, see ``rejected``)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__src"),
                    *([F.lower(format_col).alias("__fmt")] if kind == "dispatch" else []))
    if kind == "html":
        d = H.with_html_text(d, "__src", "__txt").select("doc_id", P.paragraphs("__txt").alias("ps"))
    elif kind == "txt":
        d = d.select("doc_id", P.stanzas("__src").alias("ps"))
    elif kind == "text":
        d = d.select("doc_id", P.paragraphs("__src").alias("ps"))
    elif kind == "dispatch":
        d = d.withColumn("__html", F.when(F.col("__fmt") == ".html", F.col("__src")))
        d = H.with_html_text(d, "__html", "__txt").select("doc_id", F.when(
            F.col("__fmt") == ".html", P.paragraphs("__txt")).when(F.col("__fmt") == ".txt", P.stanzas("__src")).alias("ps"))
    else:
        raise ValueError(f"unsupported passage kind: {kind}")
    return d.select("doc_id", F.posexplode("ps").alias("passage_no", "text")) \
        .withColumn("passage_no", F.col("passage_no").cast("int"))


def rejected(docs: DataFrame, id_col: str = "doc_id", format_col: str = "format") -> DataFrame:
    """The documents that 'dispatch' gives no passages for, and why."""
    fmt = F.lower(format_col)
    return docs.where(fmt.isNull() | ~fmt.isin(".html", ".txt")).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.concat(F.lit("unsupported file type: "), F.coalesce(fmt, F.lit(""))).alias("reason"))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that owns a checkpoint folder, made at its first start."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(checkpoint)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    ids = [f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("stream-")]
    if not ids:
        ids = [f"stream-{uuid.uuid4().hex[:12]}"]
        fs.createNewFile(sc._jvm.org.apache.hadoop.fs.Path(folder, ids[0]))
    return min(ids)


def earlier_keys(spark: SparkSession, results_path: str, run_id: int, own: str) -> DataFrame | None:
    """Keys that other streams of the run have stored; None where there are none.
    Files of the stream ``own`` are never read."""
    try:
        stored = spark.read.parquet(results_path)
    except AnalysisException as e:
        if is_missing(e):
            return None
        raise
    stored = stored.where((F.col("run_id") == run_id) & (F.col("stream") != own)).select(*KEYS)
    return stored if stored.limit(1).count() else None


def score_stream(spark: SparkSession, source_dir: str, schema: str, kind: str,
                 judges: Sequence[C.Judge], results_path: str, checkpoint: str,
                 id_col: str = "doc_id", text_col: str = "text", fmt: str = "parquet",
                 max_files_per_trigger: int | None = None,
                 available_now: bool = True, criterion: str = "", work: str | None = None,
                 run_id: int = 0, format_col: str = "format") -> StreamingQuery:
    """Start the scoring stream; returns the running query. Column judges
    run in the batch itself; model judges (``Judge(call=...)``) need ``work``
    (a shared folder) and ``criterion`` and run as a staged cascade. Results are
    stored below ``run_id=<run>/stream=<id>/epoch_id=<batch>``."""
    python_judges = any(j.call is not None for j in judges)
    if python_judges and not work:
        raise ValueError("model judges need work= (a shared folder for the stage tables)")
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.load(source_dir)
    passages = shape_passages(docs, kind, id_col, text_col, format_col).dropDuplicates(KEYS)
    own = stream_id(spark, checkpoint)
    earlier = earlier_keys(spark, results_path, run_id, own)

    def judge_batch(batch: DataFrame, epoch_id: int) -> None:
        todo = batch if earlier is None else batch.join(earlier, KEYS, "left_anti")
        if python_judges:
            run = C.CascadeRun(batch.sparkSession, f"{work.rstrip('/')}/{own}/epoch-{epoch_id}", run_id, judges, criterion)
            run.freeze_passages(todo)
            stored = run.passages()
            out = run.run(stored).join(stored, KEYS).drop("run_id")
        else:
            out = C.cascade_rules(todo, judges, KEYS, carry=["text"])
        out.write.mode("overwrite").parquet(f"{results_path.rstrip('/')}/run_id={run_id}/stream={own}/epoch_id={epoch_id}")

    writer = passages.writeStream.foreachBatch(judge_batch) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now \
        else writer.trigger(processingTime="30 seconds")
    return writer.start()
