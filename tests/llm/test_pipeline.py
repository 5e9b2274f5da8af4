"""The mix and bpe stages against brute force, with repeated and null ids."""
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, source string, row_ int, copies_ string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        text = f"t{i} " + "word " * int(rng.integers(0, 30))
        rows.append(([i, None, 7][i % 3], text, [None, "a", "b", "c"][int(rng.integers(0, 4))], 1, "x"))
    rows += [rows[1]] * 3 + [(7, "same text", "a", 2, "y")] * 5 + [(None, None, "a", 3, "z"), (7, "", None, 4, None)]
    return spark.createDataFrame(rows, SCHEMA)


def _mix(rows):
    """Copies of each of ``rows`` (id, text, source)."""
    size = [len((r[1] or "").split()) for r in rows]
    key = ["1" if r[2] is None else "0" + r[2] for r in rows]
    order = [int(hashlib.md5(f"mix-1{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode())
                 .hexdigest()[:15], 16) for r in rows]
    total = {k: sum(n for n, o in zip(size, key) if o == k) for k in sorted(set(key))}
    weight = {k: i % 3 + 1 for i, k in enumerate(total)}
    target, open_ = {}, set(total)
    while True:
        level = (sum(total.values()) - sum(target.values())) / sum(weight[k] for k in open_)
        capped = {k for k in open_ if level * weight[k] > 3 * total[k]}
        if not capped:
            break
        target |= {k: 3.0 * total[k] for k in capped}
        open_ -= capped
    target |= {k: level * weight[k] for k in open_}
    items, upto = [], Counter()
    for at in sorted(range(len(rows)), key=lambda i: (key[i], order[i], i)):
        k = key[at]
        upto[k] += size[at]
        items += [((upto[k] + e * total[k]) / target[k], k, e, order[at], at) for e in range(3) if size[at]]
    left, taken = sum(size), Counter()
    for *_, at in sorted(items):
        taken[at] += min(left, size[at])
        left -= min(left, size[at])
    return [int(taken[i] / n + 0.5) if n else 0 for i, n in enumerate(size)]


def test_mix_decides_row_by_row(spark, docs):
    rows = docs.select("doc_id", "text", "source").collect()
    copies = _mix(rows)
    want = Counter()
    for r, n in zip(docs.collect(), copies):
        want[tuple(r)] += n
    got = corpus_pipeline.mixed(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == +want
    nulls = [n for r, n in zip(rows, copies) if r[0] is None and r[1]]
    assert len(set(nulls)) > 1 and corpus_pipeline.mixed(spark, docs.limit(0), "").count() == 0


def test_bpe_codes_every_row(spark, docs):
    docs = docs.where("text is not null")
    library = Tokenizer.from_file(str(public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    got = corpus_pipeline.bpe(spark, docs, "").collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got) == want
