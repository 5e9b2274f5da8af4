"""A third of all rows under one id, null ids and repeated rows."""
import duckdb
import numpy as np
import public_tokenizers
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import mixing, quality, token_files, top_k


def test_repeated_and_null_query_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(50, rows[50][1]), (50, rng.standard_normal(6).tolist()), (None, rows[50][1]), (None, rng.standard_normal(6).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=str)
    live = [(n, i, [int(np.floor(256 * x)) for x in v]) for n, (i, v) in enumerate(rows)]
    want = []
    for n, i, a in live:
        if i is not None and i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), j is None, j or 0) for m, j, b in live if m != n)[:5]
            want += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(best)]
    assert got == sorted(want, key=str) and len(got) == 5 * 4


def test_top_k_prunes_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** -(i // 100)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0, block=64).collect())
    live = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for i, a in live:
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in live if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def _mixed_rows():
    rows = [(i % 40, f"w{i} " * (1 + i % 7), "s%d" % (i % 4)) for i in range(300)]
    rows += [(None, "n%d " % i * (1 + i % 5), "s1") for i in range(200)] + [(7, "same text", "s2")] * 100
    return rows


def test_mix_of_hot_ids_agrees_over_splits(spark):
    rows = _mixed_rows()
    schema = "doc_id long, text string, source string"
    runs = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, schema).withColumn("r", F.rand(parts)).repartition(parts, "r").drop("r")
        runs.append(sorted((tuple(r) for r in mixing.mix(df).drop("row").collect()), key=str))
    assert runs[0] == runs[1] and len(runs[0]) == 600
    sized = mixing._shuffled(spark.createDataFrame(rows, schema), "doc_id", "text", "source", "s")
    # rows of one id are spread over the buckets, equal rows alone share one
    most = sized.where("doc_id is null").groupBy("key", F.shiftright("h", 50)).count().agg(F.max("count")).first()[0]
    assert most < 10


def test_mix_of_repeated_ids_equals_sql(spark):
    rows = [r for r in _mixed_rows() if r[1] != "same text"]
    con = duckdb.connect()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con.register("t", df.toPandas())
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM t")
    got = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect()
    assert all(abs(r.n - r.target) <= 40 for r in got) and sum(r.n for r in got) == sum(len(r[1].split()) for r in rows)


def test_token_files_of_a_hot_id(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, f"text number {i}") for i in range(100)] + [(None, f"null {i}") for i in range(100)] + [(5, "same")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")     # else so small a table is one file
    try:
        index = token_files.write_token_files(df, path)
    finally:
        spark.conf.unset(coalesce)
    got = token_files.read_checksums(index).orderBy("start").collect()
    assert index.select("file").distinct().count() > 4      # nulls and the hot id lie in several files
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at, tok = 0, Tokenizer.from_file(path)
    sums = sorted(zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted(r.ids_crc32 for r in got) == sums


def test_quality_trains_on_one_row_of_an_id(spark):
    docs = [(i, f"good plain words number {i} in a line") for i in range(60)] + [(100 + i, "buy $$$ now !!! %d" % i) for i in range(60)]
    docs += [(3, f"other text {i}") for i in range(40)] + [(4, docs[4][1])] * 40
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(3, 0)]
    one = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    seen = []
    fit = quality.Machine.fit
    try:
        quality.Machine.fit = lambda self, ids, x, per, y, **kw: (seen.append(len(y)), fit(self, ids, x, per, y, **kw))
        got = quality.quality_scores(one, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    finally:
        quality.Machine.fit = fit
    kept = [i for i in [*range(60), *range(100, 160)] if zlib.crc32(str(i).encode()) % 5]
    assert seen == [len(kept)] and len(got) == len(docs)
