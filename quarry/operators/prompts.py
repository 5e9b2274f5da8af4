"""The prompt sent to a judge for one passage and one criterion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import as_col

# The prompt contract (question, fences, both instruction forms).
# The JSON sample uses single braces (the model is meant to copy it).
QUESTION = "Does a segment of this text match the following criteria:"
FENCE = "```"
FINAL_INSTRUCTIONS = """If it matches, respond in this JSON format (do not add any commentary or extra text):
{
    "verdict": 1,
    "excerpt": "Write out all relevant text from the segment, including both context and the main match.",
    "explanation": "Write a brief 1-sentence explanation of what you found."
}
If it does not match, respond with:
{
    "verdict": 0
}"""
SHORT_INSTRUCTIONS = ('Please answer with "1" if it matches, "0" if it does not. '
                      'You must answer with one of the two. If unsure, put 1.')
TEXT_OPEN = 'Text: """'
TEXT_CLOSE = '"""'

# Sampling options of a try and of a vote sample.
TRY_OPTIONS = {"temperature": 0.1, "top_p": 0.9, "num_predict": 4096, "num_ctx": 4096}
SAMPLE_OPTIONS = {"temperature": 0.3, "top_p": 0.9, "num_predict": 4096}


def build_prompt(criterion, text, final) -> Column:
    """Question, fenced criterion, instructions (JSON form for the final
    model), blank line, quoted passage."""
    final = final if isinstance(final, Column) else F.lit(bool(final))
    instructions = F.when(final, F.lit(FINAL_INSTRUCTIONS)).otherwise(F.lit(SHORT_INSTRUCTIONS))
    nl = F.lit("\n")
    return F.concat(F.lit(QUESTION), nl, F.lit(FENCE), nl, as_col(criterion), nl, F.lit(FENCE), nl,
                    instructions, nl, nl, F.lit(TEXT_OPEN), as_col(text), F.lit(TEXT_CLOSE))
