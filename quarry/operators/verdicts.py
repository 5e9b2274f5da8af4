"""From raw model answers to verdicts: M2-M7, M9, M10.

All parsing is Column expressions (no Python per row): strict JSON goes
through ``from_json`` on a bracket-wrapped slice, so trailing text, a second
object, single quotes or a raw newline inside a string make it invalid, as
Python's ``json.loads`` would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, py_strip

# Labels, confidences and messages of the verdict contract.
POSITIVE = "1"
NEGATIVE = "0"
CONF_EXACT = 0.95          # '1', '0', '1: ...' or a parsed JSON verdict
CONF_LOOSE = 0.85          # only one of the two labels occurs in the answer
CONF_ACCEPTED = 0.95       # confidence of a passage every model accepted
CONF_ERROR = 0.0           # a failed judge call
MATCH_MESSAGE = "Match detected."
EXPLANATION_JOIN = "\n\nExplanation: "
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
MAX_ATTEMPTS = 3
VOTE_SAMPLES = 5

JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true",
                "allowUnquotedControlChars": "false", "mode": "PERMISSIVE"}

def final_answer(raw) -> Column:
    """M2: the text after the last ``</think>`` (stripped); an opened but
    unclosed ``<think>`` means the answer was cut off (null = unclear)."""
    s = py_strip(as_col(raw))
    return F.when(s.contains(THINK_CLOSE), py_strip(F.substring_index(s, THINK_CLOSE, -1))) \
        .when(s.contains(THINK_OPEN), F.lit(None).cast("string")) \
        .otherwise(s)


def sample_answer(raw) -> Column:
    """Answer of a vote sample: reasoning removed when complete; a cut-off
    reasoning block is left as it is."""
    s = py_strip(as_col(raw))
    return F.when(s.contains(THINK_CLOSE), py_strip(F.substring_index(s, THINK_CLOSE, -1))) \
        .otherwise(s)


def _verdict(clear, label, conf, expl) -> Column:
    return F.struct(F.lit(clear).alias("clear"), F.lit(label).cast("string").alias("label"),
                    F.lit(conf).cast("double").alias("confidence"),
                    (expl if isinstance(expl, Column) else F.lit(expl)).cast("string")
                    .alias("explanation"))


def _unclear() -> Column:
    return F.struct(F.lit(False).alias("clear"), F.lit(None).cast("string").alias("label"),
                    F.lit(None).cast("double").alias("confidence"),
                    F.lit(None).cast("string").alias("explanation"))


def json_last(entries: Column, key: str) -> Column:
    """Value of ``key`` in a parsed object, the last one when a key repeats
    (as Python's ``json.loads``); null when absent."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def parse_text_verdict(answer) -> Column:
    """M4: the plain-text rules, in order; unclear when none applies."""
    a = as_col(answer)
    has1, has0 = a.contains(POSITIVE), a.contains(NEGATIVE)
    return F.when(a.isNull(), _unclear()) \
        .when(a.startswith(POSITIVE + ":"),
              _verdict(True, POSITIVE, CONF_EXACT, py_strip(a.substr(F.lit(3), F.length(a))))) \
        .when(a == POSITIVE, _verdict(True, POSITIVE, CONF_EXACT, MATCH_MESSAGE)) \
        .when(a == NEGATIVE, _verdict(True, NEGATIVE, CONF_EXACT, "")) \
        .when(has1 & ~has0, _verdict(True, POSITIVE, CONF_LOOSE, MATCH_MESSAGE)) \
        .when(has0 & ~has1, _verdict(True, NEGATIVE, CONF_LOOSE, "")) \
        .otherwise(_unclear())


def with_verdict(df: DataFrame, raw: str, final, out: str) -> DataFrame:
    """M2-M4 as a chain of projections: each costly step (strip, slice,
    strict parse) is its own column, computed once per row; Catalyst keeps the
    projections apart because a later one reads them more than once.
    ``final`` is a bool or a boolean Column."""
    tmp = [f"__{out}_{n}" for n in ("ans", "slice", "parsed", "json")]
    ans, sl, parsed, js = tmp
    d = df.withColumn(ans, final_answer(raw))
    text_v = parse_text_verdict(ans)
    if final is False:
        return d.withColumn(out, text_v).drop(ans)
    final_c = final if isinstance(final, Column) else F.lit(bool(final))
    d = d.withColumn(sl, F.when(final_c, F.regexp_extract(ans, r"(?s)\{.*\}", 0)))
    d = d.withColumn(parsed, F.when(F.length(sl) > 0, F.from_json(
        F.concat(F.lit("["), F.col(sl), F.lit("]")), "array<map<string,string>>", JSON_OPTIONS)))
    ok = F.col(parsed).isNotNull() & (F.size(parsed) == 1) & F.element_at(parsed, 1).isNotNull()
    d = d.withColumn(js, F.when(ok, F.map_entries(F.element_at(parsed, 1))))
    entries = F.col(js)
    verdict = F.coalesce(json_last(entries, "verdict"), F.lit(NEGATIVE))
    combined = py_strip(F.concat(F.coalesce(json_last(entries, "excerpt"), F.lit("")),
                                 F.lit(EXPLANATION_JOIN),
                                 F.coalesce(json_last(entries, "explanation"), F.lit(""))))
    return d.withColumn(out, F.when(entries.isNull(), text_v)
                        .when(verdict == POSITIVE, _verdict(True, POSITIVE, CONF_EXACT, combined))
                        .otherwise(_verdict(True, NEGATIVE, CONF_EXACT, ""))).drop(*tmp)


def resolve_attempts(attempts: DataFrame, keys: Sequence[str], attempt_col: str = "attempt",
                     verdict_col: str = "v") -> DataFrame:
    """M5: per key, the clear verdict of the earliest try among the first
    three; keys with no clear try get ``status='unresolved'`` (to M6/M7).

    One partial+final aggregate on the keys; each key has at most three rows.
    """
    keys = list(keys)
    v = F.col(verdict_col)
    tries = attempts.where(F.col(attempt_col) <= MAX_ATTEMPTS)
    agg = tries.groupBy(*keys).agg(
        F.min(F.when(v["clear"], F.col(attempt_col))).alias("attempt"),
        F.min_by(v, F.when(v["clear"], F.col(attempt_col))).alias("__v"))
    return agg.select(
        *keys, "attempt",
        F.when(F.col("attempt").isNotNull(), F.col("__v.label")).alias("label"),
        F.when(F.col("attempt").isNotNull(), F.col("__v.confidence")).alias("confidence"),
        F.when(F.col("attempt").isNotNull(), F.col("__v.explanation")).alias("explanation"),
        F.when(F.col("attempt").isNotNull(), F.lit("clear")).otherwise(F.lit("unresolved"))
        .alias("status"))


def label_shares(samples: DataFrame, keys: Sequence[str], label_col: str = "label",
                 raw_col: str = "raw") -> DataFrame:
    """M6: per key and asked label, the share of samples whose answer
    contains that label."""
    hit = sample_answer(raw_col).contains(F.col(label_col)).cast("int")
    return samples.groupBy(*keys).agg(
        (F.sum(F.when(F.col(label_col) == POSITIVE, hit)).cast("double")
         / F.count(F.when(F.col(label_col) == POSITIVE, True))).alias("share_pos"),
        (F.sum(F.when(F.col(label_col) == NEGATIVE, hit)).cast("double")
         / F.count(F.when(F.col(label_col) == NEGATIVE, True))).alias("share_neg"))


def resolve_by_vote(shares: DataFrame) -> DataFrame:
    """M7: normalise the two shares; positive only when strictly larger; both
    zero is an error, which becomes a negative with confidence 0 (M10)."""
    p = F.coalesce(F.col("share_pos"), F.lit(0.0))
    n = F.coalesce(F.col("share_neg"), F.lit(0.0))
    total = p + n
    norm_p = F.when(total > 0, p / total)
    norm_n = F.when(total > 0, n / total)
    err = total <= 0
    return shares.select(
        *[c for c in shares.columns if c not in ("share_pos", "share_neg")],
        F.when(err, F.lit(NEGATIVE)).when(norm_p > norm_n, F.lit(POSITIVE))
        .otherwise(F.lit(NEGATIVE)).alias("label"),
        F.when(err, F.lit(CONF_ERROR)).when(norm_p > norm_n, norm_p)
        .otherwise(norm_n).alias("confidence"),
        F.when(~err & (norm_p > norm_n), F.lit(MATCH_MESSAGE)).otherwise(F.lit(""))
        .alias("explanation"),
        F.when(err, F.lit("error")).otherwise(F.lit("vote")).alias("status"))


def cascade_trail(labels, n_models) -> Column:
    """M9: ``Model 1: 1 | Model 2: 0 → rejected`` or
    ``Model 1: 1 | Model 2: 1 | → All 2 approved``.

    ``labels`` is an array of the labels in model order, ending at the first
    rejection; ``n_models`` the cascade length.
    """
    labels = as_col(labels)
    n_models = n_models if isinstance(n_models, Column) else F.lit(n_models)
    steps = F.transform(labels, lambda lab, i: F.concat(
        F.lit("Model "), (i + 1).cast("string"), F.lit(": "), lab))
    rejected = F.element_at(labels, -1) == NEGATIVE
    body = F.array_join(steps, " | ")
    return F.when(rejected, F.concat(body, F.lit(" → rejected"))) \
        .otherwise(F.concat(body, F.lit(" | → All "), n_models.cast("string"),
                            F.lit(" approved")))
