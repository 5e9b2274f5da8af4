"""HTML character references, decoded as the HTML5 rules say.

The named-reference table has over two thousand entries (and legacy names
that need no semicolon), so decoding uses the standard library's
``html.unescape`` in an Arrow-batched pandas UDF. Callers pass null for text
without '&', so only those rows cross into Python.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _unescape_all_fn(texts: pd.Series) -> pd.Series:
    def one(arr):
        if arr is None:
            return None
        return [None if t is None else (html.unescape(t) if "&" in t else t) for t in arr]
    return texts.map(one)


def _unescape_fn(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else (html.unescape(t) if "&" in t else t))


# Marked non-deterministic so the optimizer keeps the call in its own
# projection (it is never inlined into a later higher-order function, where a
# Python function cannot run) and evaluates it once per row.
_unescape_all = F.pandas_udf(_unescape_all_fn, ArrayType(StringType())).asNondeterministic()
_unescape = F.pandas_udf(_unescape_fn, StringType()).asNondeterministic()


def unescape(c: Column) -> Column:
    """Decode references in a string column (Python only where '&' occurs)."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def unescape_each(arr: Column) -> Column:
    """Decode references in every string of an array column."""
    has_amp = F.exists(arr, lambda t: t.contains("&"))
    return F.coalesce(_unescape_all(F.when(has_amp, arr)), arr)
