"""Operators 1, 2, 5, 8 and the pipeline against brute force."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import jaccard_join as J
from quarry.llm import near_vectors, quality, shingles, top_k
from quarry.llm.components import components

SF = "/root/testdata/sf0.001"


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(4)
    met = 0
    for k in rng.integers(1, 300, 1500):
        a = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2)
        most = 2 * int(k) // 7 + 2
        b = np.concatenate([a[int(rng.integers(0, most)):], rng.integers(0, 2**63, int(rng.integers(0, most)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(b) and 4 * both >= 3 * (len(a) + len(b) - both):
            met += 1
            sig, own = shingles.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert len(np.intersect1d(sig[own == 0], sig[own == 1]))
            s = shingles.Sketches(shingles.parity_sketches(np.concatenate([a, b]), np.array([len(a), len(b)])))
            assert s.differ(np.array([0]), np.array([1]))[0] <= len(a) + len(b) - 2 * both
    assert met > 300


def test_shared_rows_over_batch_ends():
    rng = np.random.default_rng(1)
    rows = sorted({(int(s), int(c)) for s, c in zip(rng.integers(0, 60, 200), rng.integers(0, 30, 200))})
    rows = sorted(rows + rows[::7])
    for size in (1, 2, 3, 50, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p]), pa.array([r[1] for r in p])], ["sig", "c"])
                 for p in (rows[i:i + size] for i in range(0, len(rows), size))]
        got = sorted(t for b in J._shared_only(iter(parts)) for t in zip(*(c.to_pylist() for c in b.columns)))
        groups = {}
        for s, c in set(rows):
            groups.setdefault(s, set()).add(c)
        assert got == sorted((s, c, min(g)) for s, g in groups.items() if len(g) > 1 for c in g)


def _sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 3])
def test_jaccard_components(spark, block):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(400)]
    bases = [list(rng.choice(vocab, int(rng.integers(3, 120)))) for _ in range(8)]
    texts = [None, "", "  \t", "One two", "one TWO", "one two three four five", "x" * 5000]
    passage = " ".join(rng.choice(vocab, 30))
    for _ in range(150):
        t = list(bases[int(rng.integers(0, 8))])
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, len(t)))] = str(rng.choice(vocab))
        texts.append(" ".join(t))
    texts += [passage + " " + " ".join(rng.choice(vocab, 40)) for _ in range(25)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, c int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, block=block).collect()}
    sets = [_sets(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = _components(len(texts), links)
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_jaccard_edges(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other words are here now"), (None, None)]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (3, 1, 3), (None, 0, None)], key=str)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(1, 61) if i != 31}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] * rng.uniform(0.5, 2) + rng.standard_normal(16) * rng.choice([0.02, 0.3, 1.0])).tolist(), 1)
            for i in range(400)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [1.0] * 15 + [float("nan")], 1), (503, [None] + [1.0] * 15, 1),
             (504, rows[3][1], 1), (505, rows[3][1], 1), (506, [0.5] * 4, 1), (507, [0.5] * 4, 1), (508, [float("inf")] * 16, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int")


def _fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4096, 40])
def test_near_vectors(vectors, block):
    rows, df = vectors
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df, block=block).collect()}
    live = [(i, np.array(v)) for i, v, _ in rows if _fine(v) and any(v)]
    links = [(i, j) for i, a in live for j, b in live if i < j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9]
    ids = sorted(r[0] for r in rows)
    root = _components(len(ids), [(ids.index(a), ids.index(b)) for a, b in links])
    count = {i: sum(i in p for p in links) for i in ids}
    assert got == {i: (count[i], ids[root[k]], ids[root[k]] == i) for k, i in enumerate(ids)}


def test_top_k_equals_brute_force(vectors, monkeypatch):
    rows, df = vectors
    got = sorted(tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 20 == 0).collect())
    live = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if _fine(v)]
    want = []
    for q, a in live:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in live if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_probe_prunes_without_loss():
    rng = np.random.default_rng(3)
    v = np.floor(rng.standard_normal((3000, 8)) * rng.uniform(1, 900, (3000, 1)))
    v = v[np.argsort(-np.sqrt((v**2).sum(axis=1)), kind="stable")]
    ids = rng.permutation(3000)
    best = top_k._probe(v[:50], ids[:50], np.zeros(50), v, ids, 5)
    for r in range(50):
        s = v @ v[r]
        want = sorted((-int(s[j]), int(ids[j])) for j in range(3000) if ids[j] != ids[r])[:5]
        assert [(-int(a), int(b)) for a, b in zip(best.score[r], best.ids[r])] == want


def test_top_k_large_and_empty(spark):
    rows = [(20, [1e14, 3.0]), (1, [1e14, -3.0]), (2, [2e14]), (3, [])]
    got = {(r.rank, r.vec_id, r.score) for r in top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
                                                            F.col("vec_id") == 20).collect()}
    big = 256 * 10**14
    assert got == {(1, 1, 2**63 - 1), (2, 2, 2**63 - 1), (3, 3, 0)} and big * big > 2**63
    assert top_k.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 1).count() == 0
    assert near_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_machine_equals_pairwise_sum():
    m = quality.Machine()
    ids, x, per = quality.features([b"One two two, three!", b"", b"a | b | c"])
    assert per.sum() == len(ids) == len(x)
    raw = m.raw(ids, x, per)[0]
    at = 0
    for r, n in enumerate(per):
        i, v = ids[at:at + n], x[at:at + n]
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(n) for b in range(a))
        assert abs(raw[r] - (m.bias + m.w[i] @ v + pairs)) < 1e-9
        at += n


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels)
    pdf = got.join(labels, "doc_id").where("held_out").toPandas()
    assert got.count() == docs.count() and len(pdf) > 50
    assert (pdf.predicted == pdf.quality).mean() > 0.9 and pdf.predicted[pdf.quality == 1].mean() > 0.97
    again = quality.quality_scores(docs, labels).agg(F.sum("score")).first()[0]
    assert abs(again - got.agg(F.sum("score")).first()[0]) < 1e-6


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (None, None, 1.0), (2, "", None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.accepted(docs, none).columns == docs.columns
    assert quality.quality_scores(docs.limit(0), none).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near-duplicates", "mix", "bpe"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, SF)
        from quarry.session import materialize
        docs = materialize(docs)
        after = docs.toPandas()
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality":
            scores = quality.quality_scores(spark.createDataFrame(before), spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
            assert set(after.doc_id) == set(scores.doc_id[scores.predicted == 1])
        if name == "near-duplicates":
            sets = {i: _sets(t) for i, t in zip(before.doc_id, before.text)}
            ids = sorted(sets)
            links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[ids[a]] and sets[ids[b]] and
                     100 * len(sets[ids[a]] & sets[ids[b]]) >= 75 * len(sets[ids[a]] | sets[ids[b]])]
            root = _components(len(ids), links)
            assert sorted(after.doc_id) == [ids[k] for k in range(len(ids)) if root[k] == k]
        if name == "mix":
            assert after.groupby("doc_id").size().max() <= 3 and set(after.doc_id) <= set(before.doc_id)
        if name == "bpe":
            assert len(after) == len(before) and (after.n_tokens > 0).all()
    assert docs.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "a", 1.0), (5, long, "b", 2.0), (5, "quite another text with words of its own", "c", 3.0),
            (7, long + " tail", "d", 4.0), (9, "five words are one shingle", "e", 5.0), (None, "x y z", "f", 6.0),
            (None, "x y z", "g", 7.0), (11, "x y z", "h", 8.0), (12, None, "i", 9.0), (13, "", "j", 10.0), (13, "", "k", 11.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key_ string, n_shingles double")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == sorted([(5, long), (5, rows[2][1]), (9, rows[4][1]), (0, "x y z"), (12, ""), (13, ""), (13, "")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0
