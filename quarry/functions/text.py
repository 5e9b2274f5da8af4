"""Column helpers for text shaping.

Every helper returns a ``Column`` built from JVM-side functions, so it stays
inside whole-stage code generation. Regular expressions are written out so
that they mean the same thing as Python's ``str`` methods and ``re`` module,
which decide what a passage is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The code points Python's str.isspace() and re's \s accept.
#   U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680,
#   U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
# The class below spells them out; both Java regex and RE2 read \x{...}.
# ---------------------------------------------------------------------------
WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# The same set as a plain string, for the native character trim.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
# The line boundaries of Python's str.splitlines().
#   \r\n, \n, \r, \x0b, \x0c, \x1c, \x1d, \x1e, \x85, U+2028, U+2029
LINE_BREAK = r"\r\n|[\n\r\x{0B}\f\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"

# Python's \d on str patterns: Unicode decimal digits.
DIGITS_ONLY = r"^\p{Nd}+$"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: drop Unicode whitespace at both ends (F1); a native
    character-set trim, no regular expression."""
    return F.trim(as_col(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """strip, then every whitespace run becomes one space (T3). Only text that
    holds another whitespace character than single spaces is replaced in."""
    return _squeeze(py_strip(c))


# whitespace but for the space; the first class passes over ASCII text at once
_UNEVEN = r"[\x00-\x1F\x7F-\x{10FFFF}&&" + WS.replace(" ", "", 1) + "]"


def _squeeze(stripped: Column) -> Column:
    return F.when(stripped.contains("  ") | stripped.rlike(_UNEVEN), F.regexp_replace(stripped, f"{WS}+", " ")).otherwise(stripped)


def collapse_each(arr) -> Column:
    """``collapse_ws`` on every string of an array, one pass per step (a
    lambda body is interpreted, so a shared sub-result is not re-evaluated)."""
    return F.transform(F.transform(as_col(arr), py_strip), _squeeze)


def is_blank(c) -> Column:
    """``s.strip() == ''``."""
    return ~as_col(c).rlike(f"[^{WS[1:-1]}]")


def is_upper(c) -> Column:
    """``str.isupper()``: at least one upper-case letter, no lower- or
    title-case one (F3)."""
    c = as_col(c)
    return c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{IsTitlecase}]")


def split_keep(c, pattern: str) -> Column:
    """``re.split(pattern, s)``: leading and trailing empty pieces kept."""
    return F.split(as_col(c), pattern, -1)


def splitlines(c) -> Column:
    """``str.splitlines()``: a final line break does not open an empty line."""
    c = as_col(c)
    parts = F.split(c, LINE_BREAK, -1)
    ends_with_break = c.rlike(f"(?:{LINE_BREAK})\\z")
    return F.when(F.length(c) == 0, F.array().cast("array<string>")) \
        .when(ends_with_break, F.slice(parts, 1, F.size(parts) - 1)) \
        .otherwise(parts)


def digits_only(c) -> Column:
    """T4: a cleaned piece made only of decimal digits counts as empty."""
    return as_col(c).rlike(DIGITS_ONLY)


def clean_piece(c) -> Column:
    """T3 + T4 on one piece: collapse whitespace, blank out number-only text."""
    cleaned = collapse_ws(c)
    return F.when(cleaned.rlike(f"^\\p{{Nd}}+{WS}*$"), F.lit("")).otherwise(cleaned)


def file_suffix(path) -> Column:
    """lower-cased suffix with its dot (``Path.suffix.lower()``)."""
    name = F.regexp_extract(as_col(path), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
