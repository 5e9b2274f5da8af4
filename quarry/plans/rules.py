"""Rule judges used by the registered cascade queries.

A rule judge answers like a model would (plain '1'/'0', reasoning blocks,
JSON, unclear text) but is an expression over the passage, so the cascade
runs without model time and the same rule can be written in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.cascade import Judge

# Fixed values: (substring test, raw answer) in test order; the last answer
# is the default. Written once and rendered for Spark and for SQL.
SCREEN = [
    (" the ", "1"),
    (" de ", "<think>looks foreign</think> 1"),
    (" und ", "maybe 1 or 0"),
    (" le ", "???"),
    (None, "0"),
]
LENGTHY = [
    (" is ", "1"),
    (" el ", "<think>hmm"),
    (" que ", "0 because short"),
    (None, "1"),
]
VERIFY = [
    (" and ", '{"verdict": 1, "excerpt": "and", "explanation": "uses and"}'),
    (" of ", "I think 1"),
    (" la ", "between 1 and 0"),
    (" en ", '{"verdict": 1.0}'),
    (None, '{"verdict": 0}'),
]


def _rule(table):
    def answer(text: Column, final: bool) -> Column:
        out = None
        for needle, raw in table:
            if needle is None:
                return out.otherwise(F.lit(raw)) if out is not None else F.lit(raw)
            cond = text.contains(needle)
            out = F.when(cond, F.lit(raw)) if out is None else out.when(cond, F.lit(raw))
        return out
    return answer


def sql_rule(table, text: str) -> str:
    parts = ["CASE"]
    for needle, raw in table:
        lit = "'" + raw.replace("'", "''") + "'"
        if needle is None:
            parts.append(f"ELSE {lit} END")
        else:
            parts.append(f"WHEN contains({text}, '{needle}') THEN {lit}")
    return " ".join(parts)


def two_judges() -> list[Judge]:
    return [Judge("screen", rule=_rule(SCREEN)), Judge("verify", rule=_rule(VERIFY))]


def three_judges() -> list[Judge]:
    return [Judge("screen", rule=_rule(SCREEN)), Judge("lengthy", rule=_rule(LENGTHY)),
            Judge("verify", rule=_rule(VERIFY))]
