"""Numbering of sparse keys, interval anti-joins, reflow and packing on small blocks."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import packing as K
from quarry.operators import passages as P
from quarry.operators import progress as R
from quarry.operators import reports as W
from quarry.operators import sequence as Q


def _rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_hashed_ids_give_bounded_blocks(spark):
    ids = spark.range(4000).select(F.lit(0).alias("run_id"), F.xxhash64("id").alias("doc_id"), (F.col("id") % 3).alias("passage_no"))
    blocked = Q.rank_blocks(ids, ["run_id"], ["doc_id", "passage_no"])
    blocks = blocked.groupBy("run_id", "__blk").count().collect()
    # never more blocks than partitions, by value there would be one a row
    assert len(blocks) <= int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in blocks) == 4000
    got = {(r.doc_id, r.passage_no): r.finding_no for r in W.number_findings(ids.withColumn("text", F.lit("t"))).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 4001))


def test_number_by_rank_within_keys(spark):
    rnd = random.Random(2)
    data = [(k, o) for k in ("a", "b", None) for o in rnd.sample(range(-10**12, 10**12), 300)]
    df = _rows(spark, [d for d in data if d[0]], "k string, o long")
    got = {(r.k, r.o): r.n for r in Q.number_by_rank(df, ["k"], ["o"], "n").collect()}
    for k in ("a", "b"):
        own = sorted(o for kk, o in data if kk == k)
        assert [got[(k, o)] for o in own] == list(range(300))
    assert Q.number_by_rank(df.limit(0), ["k"], ["o"], "n").count() == 0


def test_compress_sparse_ranges(spark):
    data = [(7, n) for n in (5, 6, 7, 10**15, 10**15 + 1, -3, 9, 9)] + [(8, 0)]
    got = sorted((r.d, r.lo, r.hi) for r in R.compress_ranges(_rows(spark, data, "d int, passage_no long"), ["d"]).collect())
    assert got == [(7, -3, -3), (7, 5, 7), (7, 9, 9), (7, 10**15, 10**15 + 1), (8, 0, 0)]


@pytest.mark.parametrize("bucket", [1, 7, 65536])
def test_pending_by_ranges_equals_expansion(spark, bucket):
    rnd = random.Random(4)
    passages = _rows(spark, [(d, n, "x") for d in (1, 2, 3) for n in range(200)], "doc_id long, passage_no int, text string")
    spans = [(d, lo, lo + rnd.randrange(-2, 30)) for d in (1, 2) for lo in rnd.sample(range(250), 6)] + [(4, 0, 10**9 if bucket > 7 else 50)]
    ranges = _rows(spark, spans, "doc_id long, lo long, hi long")
    done = {(d, n) for d, lo, hi in spans if d < 4 for n in range(lo, hi + 1)}
    got = {(r.doc_id, r.passage_no) for r in R.pending_by_ranges(passages, ranges, bucket=bucket).collect()}
    assert got == {(d, n) for d in (1, 2, 3) for n in range(200)} - done
    plan = R.pending_by_ranges(passages, ranges)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_progress_in_one_join(spark):
    passages = _rows(spark, [(d, n) for d in (1, 2) for n in range(5)], "doc_id long, passage_no int")
    done = _rows(spark, [(1, 0), (1, 3), (1, 3), (9, 9)], "doc_id long, passage_no int")
    got = {r.doc_id: (r.total, r.completed, r.remaining, r.resume_from) for r in W.progress(passages, done).collect()}
    assert got == {1: (5, 2, 3, 4), 2: (5, 0, 5, None)}


def _paragraphs(pages):
    out, cur = [], []
    for line in "".join(t for _, t in sorted(pages) if t).split("\n"):
        if line.strip():
            cur.append(line.strip())
        elif cur:
            out.append(" ".join(cur))
            cur = []
    return out + [" ".join(cur)] if cur else out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_reflow_equals_line_by_line_rule(spark, block):
    rnd = random.Random(5)
    bits = ["a", "b c", "\n", " ", "\n\n", "  \n", "\t", "x y", "\xa0", "foo.", "\n \n", "\x1c", "\x85"]
    docs = {d: [(p, "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 6)))) for p in range(rnd.randrange(0, 14))] for d in range(150)}
    rows = [(d, p, t if t or rnd.random() < .5 else None) for d, ps in docs.items() for p, t in ps]
    got = {}
    for r in P.reflow_pages(_rows(spark, rows, "doc_id long, page_no int, text string"), block=block).collect():
        got.setdefault(r.doc_id, {})[r.para_no] = r.text
    for d, ps in docs.items():
        want = _paragraphs(ps)
        assert sorted(got.get(d, {})) == list(range(len(want))) and [got[d][i] for i in range(len(want))] == want


def test_reflow_needs_few_exchanges(spark):
    plan = P.reflow_pages(_rows(spark, [(1, 0, "a")], "doc_id long, page_no int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") <= 9


def test_long_blank_runs_do_not_overflow(spark):
    text = "a" + "\n \t" * 100_000 + "b" + " " * 200_000 + "\nc"
    got = P.reflow_pages(_rows(spark, [(1, 0, text)], "doc_id long, page_no int, text string")).orderBy("para_no").collect()
    assert [r.text for r in got] == ["a", "b c"]


def _packed(parts, least=1600):
    out, cur, n = [], [], 0
    for t in parts:
        cur.append(t)
        n += len(t) + 2
        if n >= least:
            out.append("\n\n".join(cur))
            cur, n = [], 0
    return out + ["\n\n".join(cur)] if cur else out


def test_packing_over_blocks_and_spans(spark):
    rnd = random.Random(9)
    docs = {d: ["x" * rnd.choice([0, 5, 31, 200, 700, 1500, 1598, 1700]) + str(i) for i in range(rnd.randrange(0, 120))] for d in range(15)}
    df = _rows(spark, [(d, i * 2, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id long, passage_no int, text string")
    for block, span in ((1024, 1024), (16, 3), (2, 2)):
        got = {}
        for r in K.pack_passage_rows(df, block=block, span=span).collect():
            got.setdefault(r.doc_id, {})[r.passage_no] = r.text
        assert {d: [c[i] for i in range(len(c))] for d, c in got.items()} == {d: _packed(ts) for d, ts in docs.items() if ts}
    rows = _rows(spark, list(docs.items()), "doc_id long, ps array<string>").select("doc_id", P.pack_chunks("ps").alias("c"))
    assert all(r.c == _packed(docs[r.doc_id]) for r in rows.collect())


def test_block_functions_compose():
    import numpy as np
    rnd = random.Random(1)
    for _ in range(200):
        least = rnd.choice([1, 7, 30])
        parts = [[rnd.randrange(1, 12) for _ in range(rnd.randrange(0, 9))] for _ in range(3)]
        f, g, h = (K.summary_of(np.array(p, np.int64), least) for p in parts)
        left = K.composed(K.composed(f, g, least), h, least)
        right = K.composed(f, K.composed(g, h, least), least)
        for entry in range(least):
            n, k = entry, 0
            for w in sum(parts, []):
                n += w
                if n >= least:
                    n, k = 0, k + 1
            assert K.applied(left, entry, least) == K.applied(right, entry, least) == (n, k)


def test_reflow_reads_the_pages_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    schema = "doc_id long, page_no int, text string"
    rows = [(d, p, f"page {p}\n\nof {d} ") for d in range(40) for p in range(9)]
    pages = _rows(spark, rows, schema).mapInPandas(counted, schema)
    got = {(r.doc_id, r.para_no): r.text for r in P.reflow_pages(pages, block=4).collect()}
    assert got == {(d, p): (f"of {d} " if p else "") + (f"page {p}" if p < 9 else "") if p < 9 else f"of {d}" for d in range(40) for p in range(10)}
    assert seen.value == len(rows)


def test_pages_with_one_number_stay_in_order(spark):
    rows = [(1, 0, "a\n\nb"), (1, 1, " c"), (1, 1, " c"), (1, 2, "\n"), (1, 2, "\n"), (1, 3, "d"), (None, 0, "x"), (2, None, "y")]
    for block in (1, 2, 256):
        got = P.reflow_pages(_rows(spark, rows, "doc_id long, page_no int, text string"), block=block).orderBy("para_no").collect()
        assert [(r.doc_id, r.para_no, r.text) for r in got] == [(1, 0, "a"), (1, 1, "b c c"), (1, 2, "d")]


def test_numbering_makes_the_passages_once(spark):
    texts = _rows(spark, [(1, None), (2, ""), (3, "y" * 31 + "\n" + "z" * 31)], "doc_id long, text string")
    numbered = P.number_passages(texts.select("doc_id", P.paragraphs("text").alias("ps")), "ps", ["doc_id"])
    assert "Filter" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in numbered.orderBy("passage_no").collect()] == [(3, 0, "y" * 31), (3, 1, "z" * 31)]


def test_cleaned_pieces(spark):
    from quarry.functions.text import collapse_ws
    given = ["  a  b ", "a\tb\u2003\n c", "a b", "\x1f", "a\xa0b", "aéb \x85c", "", "a\u3000\u3000b"]
    got = [r.c for r in _rows(spark, list(enumerate(given)), "i int, t string").orderBy("i").select(collapse_ws("t").alias("c")).collect()]
    assert got == [" ".join(t.split()) for t in given]


def test_page_text_cuts_by_code_points(spark, scratch):
    from quarry.plans import queries as Q
    text = "é😀x. \n" * 700
    _rows(spark, [(1, text), (2, ""), (3, None), (4, "y" * 700)], "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    got = {(r.doc_id, r.page_no): r.text for r in Q.page_text(spark, scratch).collect()}
    whole = text.replace(". ", ".\n \n")
    want = {(1, i): whole[i * 700:(i + 1) * 700] for i in range(-(-len(whole) // 700))}
    assert got == want | {(4, 0): "y" * 700}


def test_jobs_meet_passages_without_dealing_them_by_target(spark):
    from quarry.operators import jobs as J
    targets = ["en", "en", "de", None]
    passages = _rows(spark, [(i, targets[i % 4]) for i in range(400)], "doc_id long, lang string")
    found = passages.select("lang").distinct()
    jobs = found.select(F.concat("lang", F.lit("-0")).alias("job_id"), F.col("lang").alias("target_file"))
    joined = J.attach_jobs(passages, jobs.unionByName(jobs.where("lang = 'en'").withColumn("job_id", F.lit("en-1"))), "lang")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    got = Counter(r.job_id for r in joined.collect())
    assert got == {"en-0": 200, "en-1": 200, "de-0": 100}
