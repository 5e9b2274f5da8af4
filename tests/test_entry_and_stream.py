import os

import pyarrow.parquet as pq

import __spark_entry__ as E
from paths import SF001
from quarry.operators import cascade as C
from quarry.plans import queries as Q
from quarry.plans.rules import two_judges
from quarry.streaming.score_stream import score_stream, shape_passages


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_runs_on_smoke_data(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF001)
        assert df.count() > 0, name


def test_stream_equals_batch_and_is_idempotent(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    docs = pq.read_table(f"{SF001}/documents.parquet").to_pandas()[["doc_id", "text"]]
    for i, part in enumerate([docs.iloc[:70], docs.iloc[70:140], docs.iloc[140:]]):
        part.to_parquet(os.path.join(src, f"part{i}.parquet"))
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    q = score_stream(spark, src, "doc_id long, text string", "text", two_judges(), out, ckpt,
                     max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = C.cascade_rules(Q.document_paragraphs(spark, SF001), two_judges(),
                            ["doc_id", "passage_no"])
    cols = ["doc_id", "passage_no", "label", "confidence", "cascade_info"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    # a replay of the same files (fresh checkpoint) adds nothing
    q2 = score_stream(spark, src, "doc_id long, text string", "text", two_judges(), out,
                      os.path.join(scratch, "ckpt2"))
    q2.awaitTermination(300)
    assert spark.read.parquet(out).count() == got.count()


def test_stream_with_model_judges(spark, scratch):
    from test_cascade import _as_python
    from quarry.plans.rules import SCREEN, VERIFY
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    docs = pq.read_table(f"{SF001}/documents.parquet").to_pandas()[["doc_id", "text"]]
    for i, part in enumerate([docs.iloc[:100], docs.iloc[100:]]):
        part.to_parquet(os.path.join(src, f"part{i}.parquet"))
    judges = [C.Judge("screen", call=_as_python(SCREEN)), C.Judge("verify", call=_as_python(VERIFY))]
    out = os.path.join(scratch, "out")
    q = score_stream(spark, src, "doc_id long, text string", "text", judges, out,
                     os.path.join(scratch, "ckpt"), max_files_per_trigger=1,
                     criterion="x", work=os.path.join(scratch, "work"), run_id=5)
    q.awaitTermination(600)
    got = spark.read.parquet(out)
    batch = C.cascade_rules(Q.document_paragraphs(spark, SF001), two_judges(), ["doc_id", "passage_no"])
    cols = ["doc_id", "passage_no", "label", "cascade_info"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_stream_batches_read_no_history(spark, scratch):
    from quarry.streaming.score_stream import earlier_keys, stream_id
    src, out, ckpt = (os.path.join(scratch, n) for n in ("in", "out", "ckpt"))
    os.makedirs(src)
    docs = pq.read_table(f"{SF001}/documents.parquet").to_pandas()[["doc_id", "text"]]
    start = lambda: score_stream(spark, src, "doc_id long, text string", "text", two_judges(), out, ckpt).awaitTermination(300)
    docs.iloc[:50].to_parquet(os.path.join(src, "a.parquet"))
    start()
    n = spark.read.parquet(out).count()
    # a second start of the same stream: old passages come again in a new file, with new ones
    docs.iloc[40:60].to_parquet(os.path.join(src, "b.parquet"))
    start()
    got = spark.read.parquet(out)
    keys = ["doc_id", "passage_no"]
    assert got.count() == got.select(keys).distinct().count() > n
    own = stream_id(spark, ckpt)
    assert {r.stream for r in got.select("stream").distinct().collect()} == {own}
    assert {r.epoch_id for r in got.select("epoch_id").distinct().collect()} == {0, 1}
    # the stream's own results are not read to know what was seen; another stream's are
    assert earlier_keys(spark, out, 0, own) is None
    other = earlier_keys(spark, out, 0, "stream-of-another")
    assert other.count() == got.count() and earlier_keys(spark, out, 1, "stream-of-another") is None


def test_broken_results_stop_a_stream(spark, scratch):
    import pytest
    out = os.path.join(scratch, "out")
    spark.range(3).withColumnRenamed("id", "something").write.parquet(out)
    with pytest.raises(Exception, match="run_id|UNRESOLVED"):
        score_stream(spark, scratch, "doc_id long, text string", "text", two_judges(), out, os.path.join(scratch, "ckpt"))


def test_stream_dispatches_by_type(spark, scratch):
    from quarry.operators import extract as X
    from quarry.streaming.score_stream import rejected
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    pages = Q.table(spark, SF001, "pages").limit(8).selectExpr("page_id AS doc_id", "'.HTML' AS format", "html AS content")
    texts = Q.table(spark, SF001, "documents").limit(20).selectExpr("doc_id + 1000 AS doc_id", "'.txt' AS format", "text AS content")
    odd = texts.limit(2).selectExpr("doc_id + 5000 AS doc_id", "'.htm' AS format", "content")
    docs = pages.unionByName(texts).unionByName(odd)
    docs.write.parquet(src)
    docs = spark.read.parquet(src)
    score_stream(spark, src, "doc_id long, format string, content string", "dispatch", two_judges(), out,
                 os.path.join(scratch, "ckpt"), text_col="content", run_id=3).awaitTermination(300)
    got = sorted((r.doc_id, r.passage_no, r.text) for r in spark.read.parquet(out).where("run_id = 3").collect())
    want, rejects = X.extract_passages(docs)
    assert got == sorted((r.doc_id, r.passage_no, r.text) for r in want.collect()) and got
    assert sorted(r.reason for r in rejected(docs).collect()) == ["unsupported file type: .htm"] * 2
    assert rejected(docs).count() == rejects.count()
