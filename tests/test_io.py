import glob
import os

from pyspark.sql import functions as F

from paths import SF001
from quarry.operators import extract as X
from quarry.operators import sinks as S
from quarry.plans import queries as Q
from quarry.sources.files import read_completed, read_documents


def test_read_and_dispatch(spark, scratch):
    d = os.path.join(scratch, "docs")
    os.makedirs(d)
    long_p = "A paragraph that is certainly longer than twenty characters."
    open(os.path.join(d, "a.HTML"), "w").write(f"<html><p>{long_p}</p></html>")
    open(os.path.join(d, "b.txt"), "wb").write(("x" * 60 + "\r\n\r\n" + "y" * 60 + "\r\n").encode())
    open(os.path.join(d, "c.htm"), "w").write("<p>ignored</p>")
    open(os.path.join(d, "d.txt"), "wb").write(b"\xff\xfe bad bytes")
    open(os.path.join(d, "e.pdf"), "wb").write(b"%PDF \xff\xfe")
    docs, bad = read_documents(spark, d)
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["d.txt"]
    passages, rejects = X.extract_passages(docs)
    got = sorted((r.content_type, r.passage_no, r.text) for r in passages.collect())
    assert got == [("paragraphs", 0, long_p), ("stanzas", 0, "x" * 60), ("stanzas", 1, "y" * 60)]
    assert sorted(r.reason for r in rejects.collect()) == ["unsupported file type: .htm", "unsupported file type: .pdf"]
    pdf = docs.where("format = '.pdf'").select("doc_id").first().doc_id
    text = spark.createDataFrame([(pdf, 0, "Page text that is long enough to be kept as a chunk.")], "doc_id long, page_no int, text string")
    passages, rejects = X.extract_passages(docs, text)
    assert [r.text for r in passages.where("content_type = 'chunks'").collect()] == ["Page text that is long enough to be kept as a chunk."]
    upper = docs.withColumn("format", F.upper("format"))
    assert X.extract_passages(upper)[0].count() == 3


def test_replacement_character_is_valid_text(spark, scratch):
    open(os.path.join(scratch, "x.txt"), "w", encoding="utf-8").write("a \ufffd stays " * 6)
    docs, bad = read_documents(spark, scratch)
    assert docs.first().content == "a \ufffd stays " * 6 and bad.count() == 0


def test_results_keyed_restart_and_reports(spark, scratch):
    res_path = os.path.join(scratch, "results")
    results = Q._run_results(spark, SF001, carry=["text"])
    S.write_results(results.drop("text"), res_path)
    S.write_results(results.drop("text"), res_path)           # a re-run adds nothing
    stored = spark.read.parquet(res_path)
    assert stored.count() == results.count()
    done = read_completed(spark, res_path, 0)
    assert done.count() == results.count()
    assert read_completed(spark, os.path.join(scratch, "nothing"), 0).count() == 0
    S.restart(spark, res_path, 0, os.path.join(scratch, "runs"))
    assert read_completed(spark, res_path, 0).count() == 0
    S.mark_run(spark, os.path.join(scratch, "runs"), 0, "complete")
    assert [r.status for r in S.run_states(spark, os.path.join(scratch, "runs")).collect()] == ["complete"]

    findings = Q.findings(spark, SF001)
    totals = Q.run_totals(spark, SF001)
    out = os.path.join(scratch, "report")
    S.write_reports(findings, totals, out)
    def whole(name, run=0):
        return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/{name}/run_id={run}/part-*")))

    found = findings.orderBy("finding_no").collect()
    assert whole("raw_quotes") == "".join(r.raw_quote + "\n" for r in found)
    t = totals.first()
    text = "Matching Paragraphs Found\n" + "=" * 50 + "\n\n" + "".join(r.detail for r in found if r.detail)
    end = f"Total paragraphs processed: {t.processed}\nMatches found: {t.found}\n"
    assert whole("detailed_results").startswith(text) and end in whole("detailed_results")[len(text):]
    S.write_reports(findings.unionByName(findings.withColumn("run_id", F.lit(1))),
                    totals.unionByName(totals.withColumn("run_id", F.lit(1))), out, simple=True)
    assert whole("raw_quotes", 1) == whole("raw_quotes", 0)
    assert "PROCESSING COMPLETE" in whole("detailed_results", 1) and "Finding #" not in whole("detailed_results", 1)
    S.restart(spark, res_path, 1, reports=out)
    assert not os.path.exists(f"{out}/raw_quotes/run_id=1") and os.path.exists(f"{out}/raw_quotes/run_id=0")


def test_read_and_validate_jobs(spark, scratch):
    import json
    from quarry.operators import jobs as J
    d = os.path.join(scratch, "jobs")
    os.makedirs(d)
    cfgs = {
        "good": {"model_names": ["screen", "verify"], "target_file": "book.html", "search_criteria": "x"},
        "missing": {"model_names": ["screen"], "search_criteria": "x"},
        "blank": {"model_names": [], "target_file": "a.txt", "search_criteria": "   "},
        "unknown": {"model_names": ["screen", "big-model"], "target_file": "a.pdf", "search_criteria": "x"},
        "htm": {"model_names": ["screen"], "target_file": "page.htm", "search_criteria": "x"},
    }
    for name, cfg in cfgs.items():
        json.dump(cfg, open(os.path.join(d, f"{name}.json"), "w"), indent=2)
    jobs = J.read_jobs(spark, d)
    got = {r.job_id: (r.valid, r.problems) for r in
           J.validate_jobs(jobs, ["screen", "lengthy", "verify"]).collect()}
    assert got == {
        "good": (True, ""),
        "missing": (False, "missing: target_file"),
        "blank": (False, "empty: model_names, search_criteria"),
        "unknown": (False, "unknown models: big-model"),
        "htm": (False, "unsupported type: .htm"),
    }


def test_jobs_of_one_file(spark, scratch):
    from quarry.operators import jobs as J
    one = '{"model_names": ["a"], "target_file": "x.txt", "search_criteria": "%d"}'
    open(os.path.join(scratch, "two.json"), "w").write(one % 1 + "\n" + one % 2 + "\n")
    open(os.path.join(scratch, "list.json"), "w").write("[" + one % 3 + ",\n" + one % 4 + "]")
    got = {(r.job_id, r.search_criteria) for r in J.read_jobs(spark, scratch).collect()}
    assert got == {("two-1", "1"), ("two-2", "2"), ("list-1", "3"), ("list-2", "4")}
    open(os.path.join(scratch, "bad.json"), "w").write("not json")
    import pytest
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        J.read_jobs(spark, scratch).collect()


def test_reports_of_two_calls_keep_both_runs(spark, scratch):
    out = os.path.join(scratch, "report")
    findings, totals = Q.findings(spark, SF001).cache(), Q.run_totals(spark, SF001).cache()
    lines = lambda run: spark.read.text(f"{out}/raw_quotes").where(F.col("run_id") == run).count()
    for run in (0, 1):
        S.write_reports(findings.withColumn("run_id", F.lit(run)), totals.withColumn("run_id", F.lit(run)), out)
    n = lines(0)
    assert n == lines(1) > 0
    assert {r.run_id for r in spark.read.text(f"{out}/detailed_results").select("run_id").distinct().collect()} == {0, 1}
    # again with nothing found: the run's own quotes go, the other run's stay
    S.write_reports(findings.limit(0).withColumn("run_id", F.lit(1)), totals.withColumn("run_id", F.lit(1)), out)
    assert lines(0) == n and not glob.glob(f"{out}/raw_quotes/run_id=1/part-*")


def test_results_are_computed_once(spark, scratch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(0, i, 0, "1") for i in range(30)], "run_id int, doc_id long, passage_no int, label string")
    counted = rows.mapInArrow(count, rows.schema)
    path = os.path.join(scratch, "results")
    S.write_results(counted, path)
    assert seen.value == 30
    S.write_results(counted, path)
    assert seen.value == 60 and spark.read.parquet(path).count() == 30


def test_empty_job_file_is_an_error(spark, scratch):
    import pytest
    from quarry.operators import jobs as J
    for name, text in (("none", ""), ("blank", " \n"), ("list", "[ ]")):
        d = os.path.join(scratch, name)
        os.makedirs(d)
        open(os.path.join(d, "job.json"), "w").write(text)
        with pytest.raises(Exception, match="no job in file"):
            J.read_jobs(spark, d).collect()


def test_passage_keys_are_unique_over_types(spark):
    passages = Q.extract_passages(spark, SF001)
    n = passages.count()
    assert passages.select("passage_key").distinct().count() == n > passages.select("doc_id", "passage_no").distinct().count()


def test_stored_ranges_of_a_run(spark, scratch):
    from quarry.operators import progress as R
    path = os.path.join(scratch, "progress")
    done = spark.createDataFrame([(1, n) for n in (0, 1, 2, 5)] + [(2, 9)], "doc_id long, passage_no int")
    R.mark_completed(done, path, 0)
    R.mark_completed(done.where("doc_id = 2"), path, 1)
    stored = spark.read.parquet(path).where("run_id = 0")
    assert sorted((r.doc_id, r.lo, r.hi) for r in stored.collect()) == [(1, 0, 2), (1, 5, 5), (2, 9, 9)]
    passages = spark.createDataFrame([(1, n) for n in range(7)] + [(2, 9)], "doc_id long, passage_no int")
    assert sorted(tuple(r) for r in R.pending_by_ranges(passages, stored).collect()) == [(1, 3), (1, 4), (1, 6)]
