"""Operators 11 to 13 against brute force and SQL."""
import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fill_middle as M
from quarry.llm import language as L
from quarry.llm import lloyd
from quarry.llm.boundary_set import ArrayOffsets, BitmapOffsets, BoundarySet, RunOffsets

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------- operator 11
def _lloyd_by_hand(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    def first(r):
        return hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]
    centroids = [v for _, v in sorted(kept, key=first)[:k]]
    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def test_lloyd_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(6) + 3 * rng.integers(0, 4)).tolist()) for i in range(700)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, [0.0] * 6), (900, None), (901, [1.0] * 5), (902, [1.0] * 5 + [None]),
             (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, chunk int")
    for shards in (1, 4):
        pairs, centroids = lloyd.lloyd(df, k=9, rounds=3, dims=6, shards=shards)
        want, by_hand = _lloyd_by_hand(rows, 9, 3, 6)
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        assert sorted((tuple(r) for r in pairs.collect()), key=key) == sorted(want, key=key)
        assert centroids.tolist() == by_hand
    digest = {r.cluster: r for r in lloyd.clusters(df, k=9, rounds=3, dims=6).collect()}
    assert digest[0].inertia == sum(d for _, _, d in want)
    assert digest[0].cluster_inertia == sum(d for _, c, d in want if c == 0)
    assert digest[0].centroid_sha256 == hashlib.sha256(",".join(map(str, by_hand[0])).encode()).hexdigest()


def test_lloyd_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = lloyd.clusters(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(lloyd.oracle()).fetchall())


def test_lloyd_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert lloyd.clusters(spark.createDataFrame([], schema)).count() == 0
    assert lloyd.clusters(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    same = lloyd.clusters(spark.createDataFrame([(i, [1.0] * 64) for i in range(5)], schema)).collect()
    # equal centroids: all vectors go to the first, the others stay where they are
    assert {(r.cluster, r.distance, r.inertia) for r in same} == {(0, 0, 0)} and len(same) == 5
    far = lloyd.clusters(spark.createDataFrame([(i, [3e38 * (-1) ** i] * 64) for i in range(4)], schema), k=1, rounds=1).collect()
    assert len(far) == 4 and all(0 <= r.distance <= 2**63 - 1 for r in far)


# ------------------------------------------------------------- operator 12
def _grams_by_hand(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        out.update(word)
        marked = f" {word} "
        for k in (2, 3):
            out.update(marked[i:i + k] for i in range(len(marked) - k + 1))
    return out


def test_grams_equal_brute_force():
    texts = ["One, two; TWO-three", "", "été Straße ÑANDÚ x", "1234 !?", "a", "漢字 かな a1b", "  lead", "tail  "]
    bucket, counts, per = L.grams([t.encode() for t in texts])
    assert len(per) == len(texts) and counts.sum() == sum(sum(_grams_by_hand(t).values()) for t in texts)
    at = 0
    seen = {}
    for t, n in zip(texts, per):
        alone = L.grams([t.encode()])
        assert alone[0].tolist() == bucket[at:at + n].tolist() and alone[1].tolist() == counts[at:at + n].tolist()
        # equal counts of counts unless two n-grams share a bucket
        assert n <= len(_grams_by_hand(t)) and n >= len(_grams_by_hand(t)) - 1
        seen[t] = set(bucket[at:at + n].tolist())
        at += n
    assert L.grams([b"TAIL lead"])[0].tolist() == sorted(seen["  lead"] | seen["tail  "])


def test_leader_minimises_and_is_sparse():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, (400, 4)) + 50 * rng.integers(0, 2, (400, 1))
    y = (x[:, 0] >= 50).astype(int)
    leader = L.Leader(200, 2)
    for _ in range(20):
        leader.step(x.ravel(), np.full(x.size, 0.5), np.full(len(x), 4), y)
    w = leader.weights(np.arange(201))
    assert (w[100:200] == 0).all() and (w[:50, 0] > 0).mean() > 0.9 and (w[50:100, 1] > 0).mean() > 0.9
    # each weight minimises z w + (beta + sqrt n) / alpha w^2 / 2 + l2 w^2 / 2 + l1 |w|
    at = 7
    curve = lambda v: (leader.z[at] * v + ((leader.beta + np.sqrt(leader.n[at])) / leader.alpha + leader.l2) * v * v / 2
                       + leader.l1 * np.abs(v))
    assert (curve(w[at]) <= curve(w[at] + 1e-4) + 1e-12).all() and (curve(w[at]) <= curve(w[at] - 1e-4) + 1e-12).all()


def test_temperature_lowers_loss():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 4000)
    logits = rng.standard_normal((4000, 3))
    logits[np.arange(4000), y] += 1.0
    t = L.calibrated(8 * logits, y)
    assert 4 < t < 16      # over-confident by a factor of about 8
    assert 0.5 < L.calibrated(logits, y) < 2


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert len(got) == docs.count() and len(held) > 150 and (held.lang_pred == held.lang).mean() > 0.97
    again = L.languages(docs).agg(F.sum("score")).first()[0]
    assert abs(again - got.score.sum()) < 1e-6


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string, h int"
    assert L.languages(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, f"the house and the river {i}", "en", "x", 1) for i in range(40)] + [
        (100 + i, f"das haus und der fluss {i}", "de", "x", 1) for i in range(40)]
    rows += [(200, None, "en", None, None), (201, "", "de", None, None), (202, "12 % 34", "en", None, None),
             (None, "the river", "de", None, None), (203, "das haus", None, None, None), (204, "der fluss " * 100_000, None, None, None)]
    rows += [(1, "the house and the river 1", "en", "x", 1)] * 60       # a hot id
    got = L.languages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (200, 201, 202))
    assert by[None].lang_pred == "en" and not by[None].held_out and by[203].lang_pred == by[204].lang_pred == "de"
    assert by[1].held_out == (__import__("zlib").crc32(b"1") % 4 == 2)
    one = L.languages(spark.createDataFrame([(1, "a b", "xx", "", 1), (3, "c", None, "", 1)], schema)).collect()
    assert {(r.lang_pred, r.score) for r in one} in ({("xx", 1.0)}, {("und", 0.0)})
    none = L.languages(spark.createDataFrame([(1, "a b", None, "", 1)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


# ------------------------------------------------------------- operator 13
@pytest.mark.parametrize("step, kind", [(1, RunOffsets), (9, BitmapOffsets), (400, ArrayOffsets)])
def test_boundary_set_select(step, kind):
    rng = np.random.default_rng(step)
    every = np.arange(0, 300_000, step)
    some = every if step == 1 else np.unique(every + rng.integers(0, step, len(every)))
    s = BoundarySet(some)
    assert isinstance(s.containers[0], kind) and len(s) == len(some) and len(s.containers) == 5
    for rank in [0, 1, len(some) // 2, len(some) - 1, *rng.integers(0, len(some), 200).tolist()]:
        assert s.select(int(rank)) == some[rank]


def _cut(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    letters = ["a", "\n", "é", "漢", "😀", "<", ">", "P", " ", "\r", " ", "\x00"]
    rows = [(i, "".join(rng.choice(letters, int(rng.integers(0, 60))))) for i in range(400)]
    rows += [(None, "x\ny\n"), (1, None), (2, ""), (3, "\n"), (4, "a<S>b\nc"), (5, "line\n" * 60_000 + "é" * 70_000), (6, "\n" * 200_000),
             (7, "no end"), (7, "no end"), (8, "<P\n><S\n><M\n>")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, form string, h1 int")
    cut = M.fill_middle(df)
    got = cut.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == \
        sorted(((i, *_cut(i, t)) for i, t in rows), key=key)
    assert Counter(r.back for r in got) == Counter(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert M.fill_middle(df.limit(0)).count() == 0


def test_fill_middle_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = M.digests(M.fill_middle(spark.read.parquet(f"{SF}/documents.parquet")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(M.ORACLE).fetchall(), key=str)


def test_fill_middle_rates(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    forms = Counter(r.form for r in M.fill_middle(df, rate=60, spm_rate=10).collect())
    assert 200 < forms["psm"] + forms["spm"] < 280 and forms["spm"] < 50
