import random

from quarry.operators.packing import pack_passage_rows
from test_passages import check_packed


def test_blocked_packing_equals_fold(spark):
    rnd = random.Random(3)
    docs = {}
    for d in range(12):
        n = rnd.randrange(0, 90)
        docs[d] = ["x" * rnd.choice([0, 5, 31, 200, 700, 1500, 1598, 1700]) for _ in range(n)]
    rows = [(d, i * 3, t) for d, ps in docs.items() for i, t in enumerate(ps)]
    df = spark.createDataFrame(rows, "doc_id long, para_no long, text string")
    first = None
    for block in (1, 4, 7, 1000):
        got = {}
        for r in pack_passage_rows(df, "para_no", block=block).collect():
            got.setdefault(r.doc_id, {})[r.passage_no] = r.text
        first = first or got
        assert got == first, block
        for d, ps in docs.items():
            have = got.get(d, {})
            check_packed(ps, [have[i] for i in range(len(have))])
