r"""Operator 13: fill-in-middle transformation by boundary sets.

A text's lines (``[^\n]*\n|[^\n]+``) end at offsets kept in a ``BoundarySet``
(array, bitmap and run containers with cumulative cardinalities). Four numbers
of a hash of the id say where prefix and middle end, as ranks of lines, and
which form is written; both cuts are selects on the set. The tags cannot occur
in a transformed text, so the form and the output give the text back
(``restored``, one native expression).

Rows stay rows: nothing is shuffled, and texts are worked on in slices of some
hundred kilobytes (one whole text at least).

Defined results: null text is the empty text (0 lines, plain, unchanged); a text
that holds one of the tags is plain; a null id hashes as the empty string;
repeated rows give equal rows; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boundary_set import BoundarySet
from .slices import binary_slices

# The tags of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

SEED = 7
RATE = 100       # texts of 100 that are transformed
SPM_RATE = 50    # transformed texts of 100 whose suffix comes first


def line_ends(text: bytes) -> np.ndarray:
    """0 and the byte offset at which every line ends."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    rest = [len(text)] if text and not text.endswith(b"\n") else []
    return np.concatenate([[0], ends, rest]).astype(np.int64)


def _characters(part: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def transform(text: bytes, h: tuple[int, int, int, int], rate: int = RATE, spm_rate: int = SPM_RATE):
    """(lines, form, prefix characters, middle characters, output) of a text."""
    ends = line_ends(text)
    n = len(ends) - 1
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or p in text or s in text or m in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    bounds = BoundarySet(ends)
    ranks = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = bounds.select(ranks[0]), bounds.select(ranks[1])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        form, out = "spm", s + suffix + p + prefix + m + middle
    else:
        form, out = "psm", p + prefix + s + suffix + m + middle
    return n, form, _characters(prefix), _characters(middle), out


def _transformed(rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in binary_slices(b.column("text")):
                part = b.slice(lo, len(texts))
                h = zip(*(part.column(k).to_pylist() for k in ("h1", "h2", "h3", "h4")))
                n, form, prefix, middle, out = zip(*(transform(t, k, rate, spm_rate) for t, k in zip(texts, h)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    group = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *group)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_transformed(rate, spm_rate),
                           f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", 3)
    first, second, middle = (F.get(parts, F.lit(i)) for i in range(3))
    return F.when(form == "psm", F.concat(first, middle, second)) \
        .when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digests(cut: DataFrame) -> DataFrame:
    """The rows of ``fill_middle`` with the sha256 of output and restored text."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                      digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls,
         sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
g AS (
  SELECT *, len(ls) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
              THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (
  SELECT *, array_to_string(ls[1 : a], '') AS prefix, array_to_string(ls[a + 1 : b], '') AS middle,
         array_to_string(ls[b + 1 : n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
