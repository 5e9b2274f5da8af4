"""The judge cascade: M1, M8, M10 (and M5-M7 inside each stage).

A passage goes to judge 1; judge k+1 only sees what judge k accepted; the
first rejection ends it. Two execution forms:

* **Column judges** (``Judge(rule=...)``): the whole cascade is one
  projection with nested ``CASE`` -- later judges are evaluated only for rows
  the earlier ones accepted, everything stays in generated code, no shuffle.
* **Python judges** (``Judge(call=...)``): the prompts of a try are cut into key
  ranges of ``range_rows``; a range is one task, and its answers are committed when
  it ends, whatever happens to the others. Answers and stage verdicts are tables
  under the run folder and re-read, so a call is never repeated (a re-used
  ``mapInPandas`` plan would call twice), and a run killed in the middle of a try
  asks again only the ranges that had not ended.

Both forms take one list of judges for all passages, or a list per row: with jobs
attached (``jobs.attach_jobs``), stage k asks the judge that the row's
``model_names`` has at place k, with the row's ``search_criteria``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import materialize, new_folder
from ..sources.files import is_missing
from . import verdicts as V
from .prompts import SAMPLE_OPTIONS, TRY_OPTIONS, build_prompt

@dataclass(frozen=True)
class Judge:
    """One model of the cascade.

    ``rule(text, final) -> Column`` gives the raw answer as an expression;
    ``call(prompts: pd.Series, options: dict) -> sequence of str`` asks a
    model for a batch of prompts (runs in the executors). ``max_in_flight``
    caps the calls of this judge that run at a time, however many ranges there are.
    """

    name: str
    rule: Callable[[Column, bool], Column] | None = None
    call: Callable[[pd.Series, dict], Sequence[str]] | None = None
    max_in_flight: int | None = None
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if (self.rule is None) == (self.call is None):
            raise ValueError("a Judge needs exactly one of rule= or call=")


def is_final_stage(k: int, n: int, single_model_final: bool = False) -> bool:
    """Only the last judge gets the JSON prompt; a lone judge gets the short
    one unless ``single_model_final``."""
    return k == n - 1 and (n > 1 or single_model_final)


# ------------------------------------------------------------------- trail
def trail(stage_idx, label, status, n_models) -> Column:
    """M9 for the stage a passage ended at (0-based ``stage_idx``): every
    earlier judge said '1'."""
    stage_idx = F.col(stage_idx) if isinstance(stage_idx, str) else stage_idx
    label = F.col(label) if isinstance(label, str) else label
    status = F.col(status) if isinstance(status, str) else status
    labels = F.concat(F.array_repeat(F.lit(V.POSITIVE), stage_idx.cast("int")), F.array(label))
    text = V.cascade_trail(labels, n_models)
    return F.when(status == "error",
                  F.regexp_replace(text, " → rejected$", " → error")).otherwise(text)


# ---------------------------------------------------------- column judges
def with_rule_verdict(df: DataFrame, raw: str, final: bool, out: str) -> DataFrame:
    """A deterministic judge answers every try and every sample the same way:
    the first try decides, else the vote over identical samples does.
    Adds ``out = struct<label, confidence, explanation, status>`` (null when
    ``raw`` is null, i.e. the passage did not reach this judge)."""
    p, s = f"__{out}_p", f"__{out}_s"
    d = V.with_verdict(df, raw, final, p).withColumn(s, V.sample_answer(raw))
    pos = F.when(F.col(s).contains(V.POSITIVE), 1.0).otherwise(0.0)
    neg = F.when(F.col(s).contains(V.NEGATIVE), 1.0).otherwise(0.0)
    total = pos + neg
    vote_pos = (total > 0) & (pos / total > neg / total)
    vote = F.struct(
        F.when(vote_pos, F.lit(V.POSITIVE)).otherwise(F.lit(V.NEGATIVE)).alias("label"),
        F.when(total <= 0, F.lit(V.CONF_ERROR)).when(vote_pos, pos / total)
        .otherwise(neg / total).alias("confidence"),
        F.when(vote_pos, F.lit(V.MATCH_MESSAGE)).otherwise(F.lit("")).alias("explanation"),
        F.when(total <= 0, F.lit("error")).otherwise(F.lit("vote")).alias("status"))
    pv = F.col(p)
    clear = F.struct(pv["label"].alias("label"), pv["confidence"].alias("confidence"),
                     pv["explanation"].alias("explanation"), F.lit("clear").alias("status"))
    return d.withColumn(out, F.when(F.col(raw).isNull(), F.lit(None))
                        .when(pv["clear"], clear).otherwise(vote)).drop(p, s)


RESULT_COLS = ("label", "confidence", "explanation", "cascade_info", "status", "model_confidence")


def cascade_rules(passages: DataFrame, judges: Sequence[Judge], keys: Sequence[str],
                  text_col: str = "text", single_model_final: bool = False,
                  carry: Sequence[str] = ()) -> DataFrame:
    """M8 for Column judges: one map-side chain of projections, no shuffle.
    Judge k+1 is evaluated only where judge k accepted (its raw answer is null
    elsewhere). ``carry`` keeps extra input columns (e.g. the text)."""
    n = len(judges)
    keep = [*keys, *carry]
    d = passages.select(*dict.fromkeys([*keep, text_col]))
    reached = F.lit(True)
    for k, judge in enumerate(judges):
        final = is_final_stage(k, n, single_model_final)
        d = d.withColumn(f"__raw{k}", F.when(reached, judge.rule(F.col(text_col), final)))
        d = with_rule_verdict(d, f"__raw{k}", final, f"__v{k}")
        v = F.col(f"__v{k}")
        reached = F.coalesce((v["label"] == V.POSITIVE) & (v["status"] != "error"), F.lit(False))

    def terminal(k: int) -> Column:
        v = F.col(f"__v{k}")
        err = v["status"] == "error"
        return F.struct(
            F.lit(V.NEGATIVE).alias("label"),
            F.when(err, F.lit(V.CONF_ERROR)).otherwise(v["confidence"]).alias("confidence"),
            F.lit("").alias("explanation"),
            trail(F.lit(k), F.lit(V.NEGATIVE), v["status"], n).alias("cascade_info"),
            F.when(err, F.lit("error")).otherwise(F.lit("rejected")).alias("status"),
            v["confidence"].alias("model_confidence"))

    last = F.col(f"__v{n - 1}")
    result = F.struct(
        F.lit(V.POSITIVE).alias("label"), F.lit(V.CONF_ACCEPTED).alias("confidence"),
        last["explanation"].alias("explanation"),
        trail(F.lit(n - 1), F.lit(V.POSITIVE), F.lit("clear"), n).alias("cascade_info"),
        F.lit("accepted").alias("status"), last["confidence"].alias("model_confidence"))
    for k in reversed(range(n)):
        v = F.col(f"__v{k}")
        result = F.when((v["label"] != V.POSITIVE) | (v["status"] == "error"), terminal(k)) \
            .otherwise(result)
    return d.select(*keep, result.alias("__r")).select(
        *keep, *[F.col(f"__r.{c}").alias(c) for c in RESULT_COLS])


def cascade_jobs(passages: DataFrame, judges: Sequence[Judge], keys: Sequence[str], stages: int,
                 text_col: str = "text", names_col: str = "model_names",
                 single_model_final: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """M8 for Column judges chosen per row: stage k asks the judge named at place
    k of ``names_col``; a row ends at its own last judge. Map-side like
    ``cascade_rules``; ``stages`` is the longest list (``jobs.longest_cascade``). A
    name no judge has, or an empty list, ends as an error."""
    keep = [*keys, *carry]
    n = F.size(names_col)
    d = passages.select(*dict.fromkeys([*keep, text_col, names_col]))
    reached = F.lit(True)
    for k in range(stages):
        name = F.get(names_col, F.lit(k))
        final = (n == k + 1) & ((n > 1) | F.lit(single_model_final))
        raw = F.lit("")
        for j in judges:
            raw = F.when(name == j.name, F.when(final, j.rule(F.col(text_col), True))
                         .otherwise(j.rule(F.col(text_col), False))).otherwise(raw)
        d = d.withColumn(f"__raw{k}", F.when(reached, raw))
        d = with_rule_verdict(d, f"__raw{k}", final, f"__v{k}")
        v = F.col(f"__v{k}")
        reached = F.coalesce((v["label"] == V.POSITIVE) & (v["status"] != "error") & (n > k + 1), F.lit(False))

    result = F.lit(None)
    for k in reversed(range(stages)):
        v = F.col(f"__v{k}")
        error = v["status"] == "error"
        rejected = F.struct(
            F.lit(V.NEGATIVE).alias("label"),
            F.when(error, F.lit(V.CONF_ERROR)).otherwise(v["confidence"]).alias("confidence"),
            F.lit("").alias("explanation"), trail(F.lit(k), F.lit(V.NEGATIVE), v["status"], n).alias("cascade_info"),
            F.when(error, F.lit("error")).otherwise(F.lit("rejected")).alias("status"),
            v["confidence"].alias("model_confidence"))
        accepted = F.struct(
            F.lit(V.POSITIVE).alias("label"), F.lit(V.CONF_ACCEPTED).alias("confidence"),
            v["explanation"].alias("explanation"), trail(F.lit(k), F.lit(V.POSITIVE), F.lit("clear"), n).alias("cascade_info"),
            F.lit("accepted").alias("status"), v["confidence"].alias("model_confidence"))
        result = F.when((v["label"] != V.POSITIVE) | error, rejected).when(n <= k + 1, accepted).otherwise(result)
    return d.select(*keep, result.alias("__r")).select(*keep, *[F.col(f"__r.{c}").alias(c) for c in RESULT_COLS])


# ---------------------------------------------------------- python judges
def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return spark.createDataFrame([], schema)


CALL_PROMPTS = 32
RANGE_ROWS = 512


def _caller(judge: Judge, options: dict):
    """The per-partition function for ``mapInPandas``: one call per
    ``CALL_PROMPTS`` prompts. A call that fails is halved until the bad prompt
    stands alone (M10): at most 2 log2(CALL_PROMPTS) calls more for each."""
    call = judge.call
    opts = {**options, **judge.options}

    def ask(prompts):
        try:
            raws = list(call(prompts, opts))
            if len(raws) != len(prompts):
                raise ValueError(f"judge returned {len(raws)} answers for {len(prompts)} prompts")
            return [(None if r is None else str(r), None) for r in raws]
        except Exception as e:  # noqa: BLE001 - recorded as an error verdict
            if len(prompts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
        half = len(prompts) // 2
        return ask(prompts[:half].reset_index(drop=True)) + ask(prompts[half:].reset_index(drop=True))

    def run(batches):
        for pdf in batches:
            got, at = [], []
            for lo in range(0, len(pdf), CALL_PROMPTS):
                answers = ask(pdf["prompt"][lo:lo + CALL_PROMPTS].reset_index(drop=True))
                got += answers
                at += [pd.Timestamp.now(tz="UTC")] * len(answers)
            out = pdf.drop(columns=["prompt"]).copy()
            out["raw"] = [r for r, _ in got]
            out["error"] = [e for _, e in got]
            out["answered_at"] = at
            yield out
    return run


class CascadeRun:
    """A resumable cascade run stored under ``{work}/runs/run_id=<id>``.

    Tables (parquet, append-only, keyed by the passage keys):
    ``passages`` -- the numbered passages (frozen at the first start), with their
    job's judges and criterion if they have them;
    ``answers``  -- every model answer (``kind`` 'try' or 'sample'), one file for
    every key range that ended;
    ``verdicts`` -- one row per passage, judge reached and generation;
    ``retries``  -- passages whose error is to be asked again, and their new generation.

    With a ``ledger`` (``sinks.RunLedger``) the run reads and writes its own state:
    started, complete; running a complete run starts it over.
    """

    def __init__(self, spark: SparkSession, work: str, run_id: int, judges: Sequence[Judge],
                 criterion: str | None = None, keys: Sequence[str] = ("doc_id", "passage_no"),
                 single_model_final: bool = False, range_rows: int = RANGE_ROWS, ledger=None):
        self.spark, self.run_id, self.judges = spark, int(run_id), list(judges)
        self.criterion, self.keys = criterion, list(keys)
        self.single_model_final, self.range_rows, self.ledger = single_model_final, range_rows, ledger
        self.work = work.rstrip("/")
        self.base = f"{self.work}/runs/run_id={self.run_id}"

    # -- schemas -------------------------------------------------------
    def _key_schema(self, df: DataFrame) -> str:
        return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in self.keys)

    def _answers_schema(self, ks: str) -> str:
        return (f"{ks}, model_idx int, kind string, attempt int, asked string, generation int, "
                f"raw string, error string, answered_at timestamp")

    def _verdicts_schema(self, ks: str) -> str:
        return (f"{ks}, model_idx int, n_models int, label string, confidence double, explanation string, "
                f"status string, attempt int, generation int, finished_at timestamp")

    def _retries_schema(self, ks: str) -> str:
        return f"{ks}, model_idx int, generation int"

    # -- stored tables -------------------------------------------------
    def passages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/passages")

    def _units(self) -> DataFrame:
        """Keys of all passages with the names of their judges; no text."""
        stored = self.passages()
        names = F.col("model_names") if "model_names" in stored.columns \
            else F.array(*[F.lit(j.name) for j in self.judges])
        return stored.select(*self.keys, names.alias("model_names"))

    def _answers(self, ks: str) -> DataFrame:
        """Every answer once: a task that ran again after its commit has stored
        its range twice, and then one of the answers counts, before an error."""
        rows = _read(self.spark, f"{self.base}/answers", self._answers_schema(ks))
        once = rows.groupBy(*self.keys, "model_idx", "kind", "attempt", "asked", "generation") \
            .agg(F.min(F.struct("error", "raw", "answered_at")).alias("a"))
        return once.select("*", "a.raw", "a.error", "a.answered_at").drop("a")

    def _retries(self, ks: str) -> DataFrame:
        return _read(self.spark, f"{self.base}/retries", self._retries_schema(ks))

    def verdicts(self) -> DataFrame:
        """The verdicts that count: those of a retried passage and stage only of
        its latest generation."""
        ks = self._key_schema(self.passages())
        stored = _read(self.spark, f"{self.base}/verdicts", self._verdicts_schema(ks))
        newest = self._retries(ks).groupBy(*self.keys, "model_idx").agg(F.max("generation").alias("__newest"))
        return stored.join(newest, [*self.keys, "model_idx"], "left") \
            .where(F.col("generation") >= F.coalesce("__newest", F.lit(0))).drop("__newest")

    # -- steps ---------------------------------------------------------
    def freeze_passages(self, passages: DataFrame, text_col: str = "text") -> DataFrame:
        """Append passages whose keys the run has not seen (numbering of stored
        passages never changes)."""
        path = f"{self.base}/passages"
        job_cols = [c for c in ("model_names", "search_criteria") if c in passages.columns]
        schema = f"{self._key_schema(passages)}, text string" + "".join(
            f", {c} {passages.schema[c].dataType.simpleString()}" for c in job_cols)
        existing = _read(self.spark, path, schema)
        new = passages.select(*self.keys, F.col(text_col).alias("text"), *job_cols) \
            .join(existing.select(*self.keys), self.keys, "left_anti")
        new.write.mode("append").parquet(path)
        return self.passages()

    def _ask(self, need: DataFrame, k: int, kind: str, options: dict) -> None:
        """Ask the judges of stage ``k`` for ``need`` (keys, judge, final, attempt,
        asked, generation), range by range. Only here texts meet their keys."""
        need = materialize(need, "need")
        counts = {r["judge"]: r["count"] for r in need.groupBy("judge").count().collect()}
        stored = self.passages()
        criterion = "search_criteria" if "search_criteria" in stored.columns else F.lit(self.criterion or "").alias("search_criteria")
        texts = stored.select(*self.keys, "text", criterion)
        meta = ["attempt", "asked", "generation"]
        schema = f"{self._key_schema(need)}, attempt int, asked string, generation int, raw string, error string, answered_at timestamp"
        for judge in self.judges:
            n = counts.get(judge.name, 0)
            if not n:
                continue
            # two forms of the prompt: the last judge of a row gets the JSON one
            asked = need.where(F.col("judge") == judge.name).join(texts, self.keys).select(
                *self.keys, *meta, build_prompt(F.col("search_criteria"), F.col("text"), F.col("final")).alias("prompt"))
            ranges = -(-n // self.range_rows)
            ranged = asked.repartitionByRange(ranges, *self.keys, *meta)
            for part in self._waves(ranged, ranges, judge.max_in_flight):
                # committer 2 moves a task's file when the task commits: ended ranges outlive the job
                part.mapInPandas(_caller(judge, options), schema).select(
                    *self.keys, F.lit(k).alias("model_idx"), F.lit(kind).alias("kind"), *meta, "raw", "error", "answered_at") \
                    .write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2") \
                    .parquet(f"{self.base}/answers")

    def _waves(self, ranged: DataFrame, ranges: int, cap: int | None):
        """The ranges at once, or ``cap`` of them at a time, each wave read from a
        written table."""
        if not cap or ranges <= cap:
            yield ranged
            return
        path = new_folder(self.spark, "ranges")
        no = F.spark_partition_id()
        ranged.withColumn("range_no", no).withColumn("wave", F.floor(F.col("range_no") / cap).cast("int")) \
            .write.partitionBy("wave").parquet(path)
        for w in range(-(-ranges // cap)):
            yield self.spark.read.parquet(path).where(F.col("wave") == w).repartition(cap, "range_no").drop("range_no", "wave")

    def _stage(self, k: int, todo: DataFrame) -> None:
        """Asks judge ``k`` about the passages ``todo`` (keys are enough) and
        stores its verdicts."""
        ks = self._key_schema(todo)
        n = F.size("model_names")
        newest = self._retries(ks).groupBy(*self.keys).agg(F.max("generation").alias("generation"))
        todo = self._units().join(todo.select(*self.keys), self.keys, "left_semi").where(n > k) \
            .join(newest, self.keys, "left").select(
                *self.keys, F.get("model_names", F.lit(k)).alias("judge"), n.cast("int").alias("n_models"),
                ((n == k + 1) & ((n > 1) | F.lit(self.single_model_final))).alias("final"),
                F.coalesce("generation", F.lit(0)).alias("generation"))
        todo = materialize(todo, "todo")
        ours = [*self.keys, "generation"]

        def answers(kind: str) -> DataFrame:
            rows = self._answers(ks).where((F.col("model_idx") == k) & (F.col("kind") == kind))
            return rows.join(todo.select(*ours, "final"), ours)

        def parsed(rows: DataFrame) -> DataFrame:
            return V.with_verdict(rows, "raw", F.col("final"), "v")

        # tries 1..3, each only for passages with no clear answer and no error yet
        for attempt in range(1, V.MAX_ATTEMPTS + 1):
            tries = answers("try")
            settled = parsed(tries).where(F.col("error").isNotNull() | F.col("v.clear")
                                          | (F.col("attempt") == attempt)).select(*ours)
            need = todo.join(settled, ours, "left_anti")
            self._ask(need.select(*self.keys, "judge", "final", F.lit(attempt).alias("attempt"),
                                  F.lit(None).cast("string").alias("asked"), "generation"), k, "try", TRY_OPTIONS)

        tries = answers("try")
        errors = tries.where(F.col("error").isNotNull()).groupBy(*ours).agg(F.min("attempt").alias("attempt"))
        resolved = V.resolve_attempts(parsed(tries.where(F.col("error").isNull())), ours)
        resolved = materialize(resolved.join(errors.select(*ours), ours, "left_anti"), "resolved")

        # vote: 5 samples for each label, only for passages still unresolved
        unresolved = resolved.where(F.col("status") == "unresolved").select(*ours)
        sampled = answers("sample").select(*ours, "attempt", "asked")
        self._ask(todo.join(unresolved, ours, "left_semi")
                  .withColumn("asked", F.explode(F.array(F.lit(V.POSITIVE), F.lit(V.NEGATIVE))))
                  .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(V.VOTE_SAMPLES))))
                  .join(sampled, [*ours, "attempt", "asked"], "left_anti")
                  .select(*self.keys, "judge", "final", "attempt", "asked", "generation"), k, "sample", SAMPLE_OPTIONS)
        samples = answers("sample").join(unresolved, ours, "left_semi")
        sample_errors = samples.where(F.col("error").isNotNull()).select(*ours).distinct()
        voted = V.resolve_by_vote(V.label_shares(
            samples.where(F.col("error").isNull()).withColumnRenamed("asked", "label_asked"),
            ours, label_col="label_asked")).join(sample_errors, ours, "left_anti")

        verdict = ["label", "confidence", "explanation", "status", "attempt"]
        no_try = F.lit(None).cast("int").alias("attempt")
        clear = resolved.where(F.col("status") == "clear").select(*ours, *verdict)
        vote = voted.select(*ours, *verdict[:-1], no_try)
        failed = errors.unionByName(sample_errors.select("*", no_try)).select(
            *ours, F.lit(V.NEGATIVE).alias("label"), F.lit(V.CONF_ERROR).alias("confidence"),
            F.lit("").alias("explanation"), F.lit("error").alias("status"), "attempt")
        # a passage is finished when the last answer it needed has come
        ended = answers("try").select(*ours, "answered_at").unionByName(answers("sample").select(*ours, "answered_at")) \
            .groupBy(*ours).agg(F.max("answered_at").alias("finished_at"))
        clear.unionByName(vote).unionByName(failed).join(ended, ours).join(todo.select(*ours, "n_models"), ours) \
            .select(*self.keys, F.lit(k).alias("model_idx"), "n_models", *verdict, "generation", "finished_at") \
            .write.mode("append").parquet(f"{self.base}/verdicts")

    def run(self, passages: DataFrame, text_col: str = "text") -> DataFrame:
        """Judge every passage not judged yet; return the results table."""
        if self.ledger is not None:
            if self.ledger.status(self.run_id) == "complete":
                self.ledger.restart(self.run_id, work=self.work)
            self.ledger.mark(self.run_id, "started")
        self.freeze_passages(passages, text_col)
        self._judge()
        if self.ledger is not None:
            self.ledger.mark(self.run_id, "complete")
        return self.results()

    def retry_errors(self) -> DataFrame:
        """Ask exactly the passages again whose latest verdict is an error,
        from the judge at which they failed; return the results table."""
        errors = self.verdicts().where(F.col("status") == "error") \
            .select(*self.keys, "model_idx", (F.col("generation") + 1).alias("generation"))
        errors = materialize(errors, "errors")
        errors.write.mode("append").parquet(f"{self.base}/retries")
        self._judge()
        return self.results()

    def _judge(self) -> None:
        units = self._units()
        stages = units.agg(F.coalesce(F.max(F.size("model_names")), F.lit(0))).first()[0]
        known = {j.name for j in self.judges}
        unknown = units.select(F.explode("model_names").alias("m")).where(~F.col("m").isin(*known)).limit(1).collect()
        if unknown:
            raise ValueError(f"no judge is named {unknown[0]['m']!r}")
        for k in range(stages):
            verdicts = self.verdicts()
            reached = units.where(F.size("model_names") > k)
            if k:
                accepted = verdicts.where((F.col("model_idx") == k - 1) & (F.col("label") == V.POSITIVE)
                                          & (F.col("status") != "error")).select(*self.keys)
                reached = reached.join(accepted, self.keys, "left_semi")
            done = verdicts.where(F.col("model_idx") == k).select(*self.keys)
            self._stage(k, reached.join(done, self.keys, "left_anti"))

    def results(self) -> DataFrame:
        """One row per finished passage: the verdict of the stage it ended at."""
        return assemble_results(self.verdicts(), self.keys, F.col("n_models")) \
            .withColumn("run_id", F.lit(self.run_id))

    def progress(self, doc_col: str = "doc_id") -> DataFrame:
        """A3 + A4 per document: passages, finished, remaining, and the
        passage to resume from (highest finished + 1)."""
        from . import reports as K
        return K.progress(self.passages().select(*self.keys), self.results().select(*self.keys),
                          self.keys, [doc_col], self.keys[-1])


def assemble_results(verdicts: DataFrame, keys: Sequence[str], n_models) -> DataFrame:
    """The terminal verdict of each passage (a rejection, an error, or the
    last judge's acceptance) with the cascade's label, confidence and trail.
    ``n_models`` is a number or a column. No aggregation: every passage ends at
    exactly one stage."""
    keys = list(keys)
    ended = (F.col("label") != V.POSITIVE) | (F.col("status") == "error") \
        | (F.col("model_idx") == n_models - 1)
    accepted = (F.col("label") == V.POSITIVE) & (F.col("status") != "error")
    return verdicts.where(ended).select(
        *keys,
        F.when(accepted, F.lit(V.POSITIVE)).otherwise(F.lit(V.NEGATIVE)).alias("label"),
        F.when(accepted, F.lit(V.CONF_ACCEPTED)).when(F.col("status") == "error", V.CONF_ERROR)
        .otherwise(F.col("confidence")).alias("confidence"),
        F.when(accepted, F.col("explanation")).otherwise(F.lit("")).alias("explanation"),
        trail("model_idx", "label", "status", n_models).alias("cascade_info"),
        F.when(F.col("status") == "error", F.lit("error"))
        .when(accepted, F.lit("accepted")).otherwise(F.lit("rejected")).alias("status"),
        F.col("confidence").alias("model_confidence"),
        *([F.col("finished_at")] if "finished_at" in verdicts.columns else []))
