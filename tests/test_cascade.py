import re

import pandas as pd
from pyspark.sql import functions as F

from paths import SF001
from quarry.operators import cascade as C
from quarry.plans import queries as Q
from quarry.plans.rules import SCREEN, VERIFY, two_judges


def _as_python(table):
    """The same rule as a Python judge that reads the passage from the prompt."""
    def call(prompts: pd.Series, options: dict):
        out = []
        for p in prompts:
            text = re.search(r'Text: """(.*)"""\Z', p, re.S).group(1)
            for needle, raw in table:
                if needle is None or needle in text:
                    out.append(raw)
                    break
        return out
    return call


def _results(df):
    return {(r.doc_id, r.passage_no): (r.label, round(r.confidence, 9), r.explanation,
                                       r.cascade_info, r.status) for r in df.collect()}


def test_python_judges_match_rule_judges_and_call_once(spark, scratch):
    passages = Q.conversation_stanzas(spark, SF001)
    want = _results(C.cascade_rules(passages, two_judges(), ["doc_id", "passage_no"]))
    judges = [C.Judge("screen", call=_as_python(SCREEN), max_in_flight=4),
              C.Judge("verify", call=_as_python(VERIFY))]
    run = C.CascadeRun(spark, scratch, 7, judges, criterion="a comparison")
    got = _results(run.run(passages))
    assert got == want
    answers = spark.read.parquet(f"{run.base}/answers")
    # a clear first try is asked once; no (key, judge, kind, attempt, label) twice
    dup = answers.groupBy("doc_id", "passage_no", "model_idx", "kind", "attempt", "asked") \
        .count().where("count > 1").count()
    assert dup == 0
    # judge 2 saw only what judge 1 accepted
    v = spark.read.parquet(f"{run.base}/verdicts")
    first_ok = v.where("model_idx = 0 AND label = '1' AND status <> 'error'").count()
    assert v.where("model_idx = 1").count() == first_ok
    # a second call of run() asks nothing new
    before = answers.count()
    run.run(passages)
    assert spark.read.parquet(f"{run.base}/answers").count() == before


def test_resume_after_partial_run(spark, scratch):
    passages = Q.conversation_stanzas(spark, SF001)
    judges = [C.Judge("screen", call=_as_python(SCREEN)), C.Judge("verify", call=_as_python(VERIFY))]
    run = C.CascadeRun(spark, scratch, 3, judges, criterion="x")
    frozen = run.freeze_passages(passages)
    # a session that judged only the first stage for some passages, then stopped
    half = frozen.where(F.col("doc_id") < 10)
    run._stage(0, half)
    n_half = spark.read.parquet(f"{run.base}/answers").count()
    assert n_half > 0
    got = _results(run.run(passages))
    want = _results(C.cascade_rules(passages, two_judges(), ["doc_id", "passage_no"]))
    assert got == want
    answers = spark.read.parquet(f"{run.base}/answers")
    assert answers.groupBy("doc_id", "passage_no", "model_idx", "kind", "attempt", "asked") \
        .count().where("count > 1").count() == 0


def test_failing_judge_becomes_error_negative(spark, scratch):
    def flaky(prompts, options):
        out = []
        for p in prompts:
            if " the " in p.split('Text: """', 1)[1]:
                raise RuntimeError("model server down")
            out.append("1")
        return out
    passages = Q.conversation_stanzas(spark, SF001)
    run = C.CascadeRun(spark, scratch, 1, [C.Judge("only", call=flaky)], criterion="x")
    res = run.run(passages)
    err = res.where("status = 'error'").collect()
    assert err and all(r.label == "0" and r.confidence == 0.0 for r in err)
    assert all(r.cascade_info == "Model 1: 0 → error" for r in err)
    ok = res.where("status = 'accepted'").collect()
    assert ok and all(r.cascade_info == "Model 1: 1 | → All 1 approved" for r in ok)


def test_progress_and_recent_of_a_run(spark, scratch):
    from quarry.operators.reports import recent
    passages = Q.conversation_stanzas(spark, SF001)
    judges = [C.Judge("screen", call=_as_python(SCREEN))]
    run = C.CascadeRun(spark, scratch, 2, judges, criterion="x")
    run.freeze_passages(passages)
    run._stage(0, run.spark.read.parquet(f"{run.base}/passages").where(F.col("doc_id") < 4))
    prog = {r.doc_id: r for r in run.progress().collect()}
    total = passages.count()
    assert sum(r.total for r in prog.values()) == total
    done = sum(r.completed for r in prog.values())
    assert 0 < done < total
    assert all(r.remaining == r.total - r.completed for r in prog.values())
    last = recent(run.results(), ["finished_at", "doc_id", "passage_no"]).collect()
    assert len(last) == 8
