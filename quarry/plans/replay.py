"""Replay answers: model answers chosen by a rule from ids of a driver table.

No driver table holds model output, so the registered verdict queries pick
each answer from the fixed list below by ``(id * a + step * b) % len``, the
same rule in Spark and in the DuckDB oracle. The list covers every branch of
the answer rules (M2-M4) and the hostile cases of the fixture notes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replayed model answers (one per line of the list).
ANSWERS = [
    "1",
    "0",
    "1: the narrator compares himself to a river",
    '{"verdict": 1, "excerpt": "as tall as a tree", "explanation": "a comparison"}',
    '{"verdict": 0}',
    "<think>let me see</think>\n1",
    "<think>I should check the second half",
    '{"verdict":1}x}',
    '{"verdict":1},{"verdict":0}',
    '{"verdict": true}',
    '{"verdict": 1.0}',
    '{"verdict": "1"}',
    '{"excerpt": "no verdict here"}',
    '{{"verdict": 1, "excerpt": "doubled", "explanation": "braces"}}',
    "",
    "The answer is 1.",
    "Answer: 0",
    "I cannot decide between 1 and 0",
    "maybe",
    'Sure! {"verdict": 1, "excerpt": "quote", "explanation": "why"} Hope this helps.',
    "<think>a</think><think>b</think> 0",
    '{"verdict": null}',
    '{"verdict": 1, "excerpt": null, "explanation": "null excerpt"}',
    "{'verdict': 1}",
    '{"verdict": 1, "excerpt": "line one\nline two", "explanation": "raw newline"}',
    "10",
    "  1  ",
    '<think>\n</think>\n\n{"verdict": 0}',
    '{"verdict": NaN}',
    '1:   spaced reason  ',
    '{"verdict": 1, "excerpt": "", "explanation": ""}',
]

# Replayed vote samples (answers to a re-asked prompt).
SAMPLES = [
    "1",
    "0",
    "<think>hmm</think> 1",
    "<think>cut off",
    "no idea",
    "10",
    "0 because",
    "I'd say 1",
]


def pick(values: list[str], index: Column) -> Column:
    """``values[index % len(values)]`` as a Column (a literal array lookup)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[CAST((({index}) % {len(values)}) + 1 AS BIGINT)]"
