from pyspark.sql import functions as F

from quarry.operators import verdicts as V
from quarry.plans.replay import ANSWERS

MATCH = "Match detected."
# answer -> what the early models and the last model make of it; None: unclear
TABLE = {
    "1": ("1", 0.95, MATCH), "0": ("0", 0.95, ""), "  1  ": ("1", 0.95, MATCH), "   0   ": ("0", 0.95, ""),
    "1:": ("1", 0.95, ""), "1:   spaced reason  ": ("1", 0.95, "spaced reason"),
    "The answer is 1.": ("1", 0.85, MATCH), "Answer: 0": ("0", 0.85, ""),
    "<think>a</think><think>b</think> 0": ("0", 0.95, ""), "<think>x</think>\n<think>unclosed": None,
    "10": None, "maybe": None, "": None, "I cannot decide between 1 and 0": None, "{'verdict': 1}": ("1", 0.85, MATCH),
}
JSON_TABLE = {  # the last model reads JSON first
    '{"verdict": 0}': ("0", 0.95, ""), '{"verdict": null}': ("0", 0.95, ""), '{"verdict": "1"}': ("1", 0.95, "Explanation:"),
    '{"verdict": true}': ("0", 0.95, ""), '{"verdict": 1, "verdict": 0}': ("0", 0.95, ""),
    '{"verdict": 0, "verdict": 1, "excerpt": "dup", "explanation": "last wins"}': ("1", 0.95, "dup\n\nExplanation: last wins"),
    'Sure! {"verdict": 1, "excerpt": "quote", "explanation": "why"} Hope.': ("1", 0.95, "quote\n\nExplanation: why"),
    '{"verdict": 1, "excerpt": null, "explanation": "n"}': ("1", 0.95, "Explanation: n"),
    '{"verdict":1}x}': ("1", 0.85, MATCH), '{"verdict":1},{"verdict":0}': None,
}


def test_verdict_table(spark):
    cases = [(a, f, w) for a, w in TABLE.items() for f in (False, True)] + [(a, True, w) for a, w in JSON_TABLE.items()]
    df = spark.createDataFrame([(i, a, f) for i, (a, f, _) in enumerate(cases)], "i int, raw string, final boolean")
    for r in V.with_verdict(df, "raw", F.col("final"), "v").collect():
        want = cases[r.i][2]
        assert ((r.v.label, r.v.confidence, r.v.explanation) if r.v.clear else None) == want, (r.raw, r.final)


def test_resolve_attempts_first_clear_wins(spark):
    rows = [(1, 1, "maybe"), (1, 2, "0"), (1, 3, "1"),
            (2, 1, "<think>cut"), (2, 2, "??"), (2, 3, "10"),
            (3, 1, "1: because"), (3, 4, "0")]
    df = V.with_verdict(spark.createDataFrame(rows, "k int, attempt int, raw string"),
                        "raw", False, "v")
    got = {r.k: (r.attempt, r.label, r.status) for r in V.resolve_attempts(df, ["k"]).collect()}
    assert got == {1: (2, "0", "clear"), 2: (None, None, "unresolved"), 3: (1, "1", "clear")}


def test_vote_ties_and_zero(spark):
    samples = ([(1, "1", "1")] * 5 + [(1, "0", "0")] * 5            # tie -> negative 0.5
               + [(2, "1", "yes 1")] * 5 + [(2, "0", "1")] * 5      # only positive -> 1.0
               + [(3, "1", "none")] * 5 + [(3, "0", "none")] * 5    # both zero -> error
               + [(4, "1", "1")] * 3 + [(4, "1", "x")] * 2 + [(4, "0", "0")] * 1 + [(4, "0", "x")] * 4)
    df = spark.createDataFrame(samples, "k int, label string, raw string")
    got = {r.k: (r.label, round(r.confidence, 6), r.explanation, r.status)
           for r in V.resolve_by_vote(V.label_shares(df, ["k"])).collect()}
    assert got[1] == ("0", 0.5, "", "vote")
    assert got[2] == ("1", 1.0, "Match detected.", "vote")
    assert got[3] == ("0", 0.0, "", "error")
    assert got[4] == ("1", 0.75, "Match detected.", "vote")


def test_cascade_trail_all_outcomes(spark):
    from quarry.operators.cascade import trail
    rows = [(0, "0", "clear"), (1, "0", "clear"), (2, "1", "clear"), (1, "0", "error")]
    df = spark.createDataFrame(rows, "k int, label string, status string")
    got = [r.t for r in df.select(trail("k", "label", "status", 3).alias("t")).collect()]
    assert got == ["Model 1: 0 → rejected", "Model 1: 1 | Model 2: 0 → rejected",
                   "Model 1: 1 | Model 2: 1 | Model 3: 1 | → All 3 approved",
                   "Model 1: 1 | Model 2: 0 → error"]
