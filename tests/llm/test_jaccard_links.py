"""Operator 8 against brute force: null ids as near copies, number of links."""
import numpy as np

from quarry.llm import jaccard_join as J


def _text(*changes):
    words = [f"w{i}" for i in range(100)]
    for at in changes:
        words[at] = f"new{at}"
    return " ".join(words)


def test_null_ids_link_as_near_copies(spark):
    # 20 and 30 link only through the texts of null id
    a, between, b = _text(), _text(10, 50), _text(10, 50, 30, 90)
    alone = "a null id with quite another text"
    rows = [(20, a), (None, between), (None, between), (30, b), (None, alone), (None, None), (None, "")]
    sets = [J.S.shingle_sets([t.encode()], 5)[0] for t in (a, between, b)]
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert jaccard(sets[0], sets[1]) >= 0.75 <= jaccard(sets[1], sets[2]) and jaccard(sets[0], sets[2]) < 0.75
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == sorted(
        [(20, 96, 20), (0, 96, 20), (0, 96, 20), (30, 96, 20), (0, 3, 0), (0, 0, 0), (0, 0, 0)])


def test_links_of_a_family(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", "one two", "ONE two"]
    for size in (30, 80, 120):
        base = [str(w) for w in rng.choice(vocab, size)]
        for _ in range(40):
            t = list(base)
            for at in rng.integers(0, size, int(rng.integers(0, 4))):
                t[at] = str(rng.choice(vocab))
            texts.append(" ".join(t))
    rows = [(None if i % 11 == 5 else i // 2, t, i) for i, t in enumerate(texts)]
    sets = [set(J.S.shingle_sets([(t or "").encode()], 5)[0].tolist()) for t in texts]
    linked = [[a != b and bool(x) and 100 * len(x & y) >= 75 * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    want = sorted((-1 if rows[a][0] is None else rows[a][0], len(sets[a]), sum(r)) for a, r in enumerate(linked))
    assert sum(n for _, _, n in want) > 1500
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for kw in ({}, {"rows": 7, "items": 900}):
        got = J.jaccard_links(df, **kw).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.n_links) for r in got) == want
    assert J.jaccard_links(df.limit(0)).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40 if i % 2 else 5000, 60)).astype(np.uint64) for i in range(60)]
    a, b = sets[:35], sets[35:]
    own = lambda p: np.repeat(np.arange(len(p)), [len(x) for x in p])
    got = J._shared(np.concatenate(a), own(a), len(a), np.concatenate(b), own(b), len(b))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
