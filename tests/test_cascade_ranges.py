"""Range-committed calls, jobs, retries and the run ledger of the staged cascade."""
import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from paths import SF001
from quarry.operators import cascade as C
from quarry.operators import sinks as S
from quarry.plans import queries as Q
from quarry.plans.rules import SCREEN, VERIFY, three_judges, two_judges
from test_cascade import _as_python, _results

KEYS = ["doc_id", "passage_no"]


def counting(call, folder, name):
    """``call`` that leaves one file for every call, a line for every prompt."""
    def run(prompts, options):
        with open(os.path.join(folder, f"{name}-{uuid.uuid4().hex}"), "w") as f:
            f.write("x\n" * len(prompts))
        return call(prompts, options)
    return run


def calls(folder, name):
    return sum(len(open(f).readlines()) for f in glob.glob(os.path.join(folder, f"{name}-*")))


def test_calls_equal_distinct_answers(spark, scratch):
    passages = Q.conversation_stanzas(spark, SF001)
    judges = [C.Judge("screen", call=counting(_as_python(SCREEN), scratch, "screen"), max_in_flight=2),
              C.Judge("verify", call=counting(_as_python(VERIFY), scratch, "verify"))]
    run = C.CascadeRun(spark, scratch, 1, judges, "x", range_rows=10)
    assert _results(run.run(passages)) == _results(C.cascade_rules(passages, two_judges(), KEYS))
    answers = spark.read.parquet(f"{run.base}/answers")
    by_judge = {r.model_idx: r["count"] for r in answers.select(*KEYS, "model_idx", "kind", "attempt", "asked").distinct()
                .groupBy("model_idx").count().collect()}
    assert by_judge == {0: calls(scratch, "screen"), 1: calls(scratch, "verify")} == {
        r.model_idx: r["count"] for r in answers.groupBy("model_idx").count().collect()}
    # a range is a task with a file of its own, bounded in rows
    sizes = [r["count"] for r in answers.where("model_idx = 1").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 30


def test_killed_run_keeps_ended_ranges(spark, scratch):
    passages = Q.conversation_stanzas(spark, SF001).cache()
    poison = passages.orderBy(F.desc("doc_id"), F.desc("passage_no")).first().text
    mark = os.path.join(scratch, "alive")
    answer = _as_python(SCREEN)

    def dies(prompts, options):
        import time
        if any(poison in p for p in prompts) and not os.path.exists(mark):
            end = time.time() + 60   # until all others have ended
            while len(glob.glob(os.path.join(scratch, "runs/run_id=2/answers/part-*"))) < 7 and time.time() < end:
                time.sleep(0.2)
            os._exit(1)              # the worker is gone, and with it the task and the job
        return answer(prompts, options)

    run = C.CascadeRun(spark, scratch, 2, [C.Judge("screen", call=counting(dies, scratch, "screen"))], "x", range_rows=10)
    with pytest.raises(Exception, match="exited unexpectedly|crashed"):
        run.run(passages)
    kept = spark.read.parquet(f"{run.base}/answers").count()
    n = passages.count()
    assert n - 40 <= kept < n        # all but the ranges that had not ended
    open(mark, "w").close()
    before = calls(scratch, "screen")
    got = _results(run.run(passages))
    first = spark.read.parquet(f"{run.base}/answers").where("attempt = 1 AND kind = 'try'").count()
    assert first == n
    again = calls(scratch, "screen") - before
    assert again == spark.read.parquet(f"{run.base}/answers").count() - kept
    assert got == _results(C.cascade_rules(passages, two_judges()[:1], KEYS))


def test_answers_stored_twice_count_once(spark, scratch):
    passages = Q.conversation_stanzas(spark, SF001)
    run = C.CascadeRun(spark, scratch, 3, [C.Judge("screen", call=_as_python(SCREEN))], "x")
    run.freeze_passages(passages)
    half = run.passages().where("doc_id < 10")
    run._stage(0, half)
    stored = spark.read.parquet(f"{run.base}/answers").collect()
    spark.createDataFrame(stored, spark.read.parquet(f"{run.base}/answers").schema).write.mode("append").parquet(f"{run.base}/answers")
    assert _results(run.run(passages)) == _results(C.cascade_rules(passages, two_judges()[:1], KEYS))


def test_errors_are_asked_again(spark, scratch):
    mark = os.path.join(scratch, "up")
    answer = _as_python(VERIFY)

    def flaky(prompts, options):
        if not os.path.exists(mark) and any(" the " in p.split('Text: """', 1)[1] for p in prompts):
            raise RuntimeError("model server down")
        return answer(prompts, options)

    passages = Q.conversation_stanzas(spark, SF001)
    judges = [C.Judge("screen", call=_as_python(SCREEN)), C.Judge("verify", call=counting(flaky, scratch, "verify"))]
    run = C.CascadeRun(spark, scratch, 4, judges, "x")
    failed = run.run(passages)
    n = failed.where("status = 'error'").count()
    total = failed.count()
    assert n > 3
    open(mark, "w").close()
    before = spark.read.parquet(f"{run.base}/answers").count()
    after = run.retry_errors()
    assert _results(after) == _results(C.cascade_rules(passages, two_judges(), KEYS))
    assert after.count() == total
    new = spark.read.parquet(f"{run.base}/answers").where("generation = 1")
    assert new.select(*KEYS).distinct().count() == n and new.where("model_idx = 0").count() == \
        failed.where("status = 'error' AND cascade_info LIKE 'Model 1: 0%'").count()
    assert spark.read.parquet(f"{run.base}/answers").count() == before + new.count()
    # what fails for good fails again, once a retry; a run without errors asks nothing
    left = after.where("status = 'error'").count()
    asked = spark.read.parquet(f"{run.base}/answers").count()
    run.retry_errors()
    again = spark.read.parquet(f"{run.base}/answers").where("generation = 2").select(*KEYS).distinct().count()
    assert again == left and spark.read.parquet(f"{run.base}/answers").count() >= asked


def test_jobs_have_judges_of_their_own(spark, scratch):
    table = {"screen": SCREEN, "verify": VERIFY}
    passages = Q.conversation_stanzas(spark, SF001)
    jobs = spark.createDataFrame([("a", ["screen", "verify"], "find a"), ("b", ["verify"], "find b"), ("c", ["verify", "screen"], "find c")],
                                 "job_id string, model_names array<string>, search_criteria string")
    rows = passages.crossJoin(F.broadcast(jobs))
    seen = os.path.join(scratch, "seen")
    os.makedirs(seen)

    def spy(name):
        answer = _as_python(table[name])

        def call(prompts, options):
            with open(os.path.join(seen, f"{name}-{uuid.uuid4().hex}"), "w") as f:
                f.writelines(p.split("```\n")[1] for p in prompts)
            return answer(prompts, options)
        return call

    run = C.CascadeRun(spark, scratch, 5, [C.Judge("screen", call=spy("screen")), C.Judge("verify", call=spy("verify"))],
                       keys=["job_id", *KEYS])
    got = run.run(rows)
    want = C.cascade_jobs(rows, two_judges(), ["job_id", *KEYS], 2)
    cols = ["job_id", *KEYS, "label", "confidence", "explanation", "cascade_info", "status"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    asked = {name: {line for f in glob.glob(os.path.join(seen, f"{name}-*")) for line in open(f)} for name in table}
    assert asked["screen"] >= {"find a\n"} and "find b\n" not in asked["screen"] and {"find b\n", "find c\n"} <= asked["verify"]
    by_job = run.progress("job_id").collect()
    assert all(r.remaining == 0 and r.total == passages.count() for r in by_job) and len(by_job) == 3
    with pytest.raises(ValueError, match="big-model"):
        C.CascadeRun(spark, scratch, 6, [C.Judge("screen", call=spy("screen"))], keys=["job_id", *KEYS]).run(
            rows.withColumn("model_names", F.array(F.lit("big-model"))))


def test_job_cascade_equals_uniform_cascade(spark):
    passages = Q.conversation_stanzas(spark, SF001)
    named = passages.withColumn("model_names", F.array(*[F.lit(j.name) for j in three_judges()]))
    assert _results(C.cascade_jobs(named, three_judges(), KEYS, 3)) == _results(C.cascade_rules(passages, three_judges(), KEYS))
    odd = passages.withColumn("model_names", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("nobody"))).otherwise(F.array().cast("array<string>")))
    assert {(r.label, r.status, r.confidence) for r in C.cascade_jobs(odd, three_judges(), KEYS, 1).collect()} == {("0", "error", 0.0)}


def test_ledger_claims_and_states(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor
    ledger = S.RunLedger(spark, os.path.join(scratch, "ledger"))
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda _: ledger.claim(), range(8)))
    assert sorted(ids) == list(range(8)) and ledger.claim() == 8
    passages = Q.conversation_stanzas(spark, SF001).where("doc_id < 6")
    judge = C.Judge("screen", call=counting(_as_python(SCREEN), scratch, "screen"))
    run = C.CascadeRun(spark, scratch, ids[0], [judge], "x", ledger=ledger)
    assert ledger.status(ids[0]) is None
    first = _results(run.run(passages))
    assert ledger.status(ids[0]) == "complete"
    asked = calls(scratch, "screen")
    ledger.mark(ids[0], "started")
    run.run(passages)                       # not complete: goes on, nothing is left to ask
    assert calls(scratch, "screen") == asked
    assert _results(run.run(passages)) == first     # complete: starts over
    assert calls(scratch, "screen") == 2 * asked and ledger.status(ids[0]) == "complete"
