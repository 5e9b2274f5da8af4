import random

from quarry.operators import progress as R


def test_docstring_ranges(spark):
    df = spark.createDataFrame([(0, n) for n in [0, 1, 2, 5, 7, 8, 9]], "k int, passage_no long")
    got = sorted((r.lo, r.hi) for r in R.compress_ranges(df, ["k"]).collect())
    assert got == [(0, 2), (5, 5), (7, 9)]


def test_round_trip_random_sets(spark):
    rnd = random.Random(7)
    sets = {k: sorted(set(rnd.randrange(0, 60) for _ in range(rnd.randrange(0, 40))))
            for k in range(30)}
    df = spark.createDataFrame([(k, n) for k, s in sets.items() for n in s + s[:3]],
                               "k int, passage_no long")
    ranges = R.compress_ranges(df, ["k"])
    back = R.expand_ranges(ranges, ["k"]).collect()
    got = {}
    for r in back:
        got.setdefault(r.k, []).append(r.passage_no)
    assert {k: sorted(v) for k, v in got.items()} == {k: s for k, s in sets.items() if s}
    # ranges are maximal: no two touch
    for k, rows in _by_key(ranges.collect()).items():
        rows.sort()
        assert all(b[0] > a[1] + 1 for a, b in zip(rows, rows[1:]))


def _by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r.k, []).append((r.lo, r.hi))
    return out


def test_pending_is_anti_join(spark):
    p = spark.createDataFrame([(1, i, "t") for i in range(5)], "doc_id long, passage_no int, text string")
    done = spark.createDataFrame([(1, 1), (1, 3), (2, 0)], "doc_id long, passage_no int")
    assert sorted(r.passage_no for r in R.pending(p, done).collect()) == [0, 2, 4]


def test_order_by_passage(spark):
    from quarry.operators.reports import order_by_passage
    rows = [(2, 0), (1, 10), (1, 9), (3, 1), (1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, passage_no int").repartition(3)
    assert [tuple(r) for r in order_by_passage(df).collect()] == sorted(rows)
