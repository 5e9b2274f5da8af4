"""Passage shaping: T3-T11 and S3.

A passage list is an ``ARRAY<STRING>`` inside a document row; every rule that
only looks at one document is a chain of ``split`` / ``transform`` /
``filter`` / ``aggregate`` on that row, so it runs map-side with no shuffle.
Numbering turns the array into rows with ``posexplode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (WS, WS_CHARS, as_col, collapse_each, digits_only,
                              is_blank, is_upper, py_strip, split_keep)
from ..session import materialize
from .sequence import running_total

# The length floors and piece counts of the passage rules.
PARAGRAPH_MIN_CHARS = 30      # keep a paragraph when longer than this
STANZA_MIN_CHARS = 50         # keep a stanza of at least this length
FALLBACK_MIN_PIECES = 10      # fewer blank-line pieces => split on every newline
HEADING_MAX_LINES = 2         # stanzas this short with an upper-case line are headings
CHUNK_MIN_CHARS = 1600        # pack paragraphs until a chunk reaches this size
CHUNK_SEPARATOR_CHARS = 2     # each paragraph counts its '\n\n' separator

BLANK_LINE_SPLIT = f"\\n{WS}*\\n+"   # paragraphs
STANZA_SPLIT = f"\\n{WS}*\\n"        # stanzas


# --------------------------------------------------------------- paragraphs
def paragraph_pieces(text) -> Column:
    """T5 + T6: split on blank lines; below 10 pieces (counted before any
    filter) split on every newline instead."""
    text = as_col(text)
    by_blank = split_keep(text, BLANK_LINE_SPLIT)
    return F.when(F.size(by_blank) < FALLBACK_MIN_PIECES, F.split(text, "\n", -1)) \
        .otherwise(by_blank)


def clean_and_filter(pieces) -> Column:
    """Clean each piece (T3 + T4), keep those longer than 30 characters.
    T4 blanks number-only pieces, which the length floor then drops, so the
    two are one filter on the collapsed piece."""
    return F.filter(collapse_each(pieces),
                    lambda p: (F.length(p) > PARAGRAPH_MIN_CHARS) & ~digits_only(p))


def paragraphs(text) -> Column:
    """A document's text to its kept paragraphs, in order."""
    return clean_and_filter(paragraph_pieces(text))


# ------------------------------------------------------------------ stanzas
def is_heading(stanza) -> Column:
    """At most two lines, one of them upper-case."""
    lines = F.split(as_col(stanza), "\n", -1)
    return (F.size(lines) <= HEADING_MAX_LINES) & F.exists(lines, is_upper)


def stanzas(text) -> Column:
    """T8 + T9: split on blank lines, strip, keep >= 50 characters, drop
    headings; inner newlines are kept."""
    pieces = F.transform(split_keep(as_col(text), STANZA_SPLIT), py_strip)
    return F.filter(pieces, lambda s: (F.length(s) >= STANZA_MIN_CHARS) & ~is_heading(s))


# ------------------------------------------------------------------ packing
def chunk_ends(lengths: Column, min_chars: int, entry=None) -> Column:
    """1-based places of the parts that close a chunk, when ``entry`` characters
    are open before the first. A fold over the lengths; it appends at closed
    chunks only."""
    start = F.struct((F.lit(0) if entry is None else entry).cast("long").alias("n"), F.lit(0).alias("i"),
                     F.array().cast("array<int>").alias("ends"))

    def step(acc, length):
        n, i = acc["n"] + length + CHUNK_SEPARATOR_CHARS, acc["i"] + 1
        full = n >= min_chars
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(n).alias("n"), i.alias("i"),
                        F.when(full, F.concat(acc["ends"], F.array(i))).otherwise(acc["ends"]).alias("ends"))

    return F.aggregate(lengths, start, step, lambda acc: acc["ends"])


def chunk_slices(parts: Column, ends: Column, text=lambda p: p) -> Column:
    """``array<struct<k, text>>``: the parts between the ``ends``, each run joined by
    a blank line; ``k`` counts chunks from 0, the last may be open, empty ones fall out."""
    # a lambda's body is evaluated for every element: what it reads is bound once before
    bound = F.array(F.struct(parts.alias("parts"), ends.alias("ends")))
    return F.element_at(F.transform(bound, lambda b: _slices(b["parts"], b["ends"], text)), 1)


def _slices(parts: Column, ends: Column, text) -> Column:
    first = lambda k: F.when(k == 0, 1).otherwise(F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1)
    last = lambda k: F.coalesce(F.get(ends, k), F.size(parts))
    runs = F.transform(F.sequence(F.lit(0), F.size(ends)), lambda k: F.struct(
        k.alias("k"), F.slice(parts, first(k), last(k) - first(k) + 1).alias("run")))
    return F.transform(F.filter(runs, lambda r: F.size(r["run"]) > 0), lambda r: F.struct(
        r["k"].alias("k"), F.array_join(F.transform(r["run"], text), "\n\n").alias("text")))


def pack_chunks(parts, min_chars: int = CHUNK_MIN_CHARS) -> Column:
    """Greedy packing in order. Each part adds ``len + 2``; when the
    running count reaches ``min_chars`` the chunk is emitted ('\\n\\n'-joined)
    and the count resets; a leftover forms the last chunk.

    The reset makes this a fold, not a window sum: one ``aggregate`` over the
    lengths of a document row, then slices of its parts.
    """
    parts = as_col(parts)
    ends = chunk_ends(F.transform(parts, F.length), min_chars)
    return F.transform(chunk_slices(parts, ends), lambda c: c["text"])


# ---------------------------------------------------------------- numbering
def number_passages(df: DataFrame, array_col: str, keep: list[str],
                    text_col: str = "text") -> DataFrame:
    """One row per kept passage, ``passage_no`` 0-based in array order."""
    # of a bare column Spark would first filter the empty arrays out, and make them twice for it
    passages = F.coalesce(array_col, F.array().cast("array<string>"))
    return df.select(*keep, F.posexplode(passages).alias("passage_no", text_col))


def passages_from_parts(parts: DataFrame, doc_key: str, part_order: str,
                        array_col: str, text_col: str = "text",
                        doc_out: str = "doc_id") -> DataFrame:
    """Number passages of documents stored as several ordered parts (turns,
    pages...) without gathering a document into one row.

    Each part carries its own passage array; a part's first passage number is
    the count of passages in earlier parts of the same document, a running
    total that stays balanced when one document holds most parts.
    """
    counted = parts.withColumn("__k", F.size(array_col).cast("long"))
    counted = running_total(counted, [doc_key], part_order, "__k", "__base")
    exploded = counted.select(
        F.col(doc_key).alias(doc_out), "__base",
        F.posexplode(array_col).alias("__pos", text_col))
    return exploded.select(
        doc_out, (F.col("__base") + F.col("__pos")).cast("int").alias("passage_no"), text_col)


# ------------------------------------------------------------ page reflow
# a whitespace run with two line breaks or more ends a paragraph; without the
# whitespace before its first line break, which the strip removes
_INLINE_WS = WS.replace("\\n", "")
PARAGRAPH_BREAK = f"\\n{_INLINE_WS}*+\\n{WS}*+"
# the first class passes over ASCII text at once
_LINE_WS = r"[\x00-\x20\x7F-\x{10FFFF}&&" + _INLINE_WS + "]"
LINE_END = f"{_LINE_WS}*+\\n{_LINE_WS}*+"
PAGE_BLOCK = 256


def _reflowed(pieces: Column) -> Column:
    """Each piece with its lines stripped and joined by one space."""
    joined = F.transform(pieces, lambda p: F.when(p.contains("\n"), F.regexp_replace(p, LINE_END, " ")).otherwise(p))
    return F.transform(joined, py_strip)


def _fused_pages(pages: DataFrame) -> DataFrame:
    """The pages of a block as one page, which has the first one's number: they are put
    together without a separator anyhow. Where a number repeats, they stay single."""
    # the pair is one key: rows that come dealt by document would else stay so, a long one in one task
    blocks = pages.groupBy(F.struct("doc_id", "blk").alias("at")) \
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("ps"))
    numbers = F.col("ps.page_no")
    fused = F.array(F.struct(numbers[0].alias("page_no"), F.array_join("ps.text", "").alias("text")))
    return blocks.select("at", F.inline(
        F.when(F.size(F.array_distinct(numbers)) == F.size(numbers), fused).otherwise(F.col("ps"))))


def reflow_pages(page_text: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                 text_col: str = "text", block: int = PAGE_BLOCK) -> DataFrame:
    """S3: page texts of one document are concatenated in page order with no
    separator (a page's last line fuses with the next page's first line);
    non-blank lines are stripped and joined by one space; a blank line ends a
    paragraph. Returns ``(doc_id, para_no, text)``, paragraphs 0-based.

    A paragraph ends exactly where two characters that are not whitespace have two
    line breaks or more between them. So a page is cut at such breaks by itself,
    and only four numbers cross pages: line breaks before its first and behind its
    last character, all its line breaks, and the paragraphs it starts. Those are
    running values. ``block`` consecutive pages are put together as one page (one
    exchange) and written once; documents of several blocks compose their values over
    the blocks' summaries, and the pieces at the edges of their blocks are joined by
    paragraph. No document is gathered.
    """
    text = F.col("text")
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    pages = page_text.select(F.col(doc_col).alias("doc_id"), F.col(page_col).alias("page_no"), F.col(text_col).alias("text")) \
        .where((F.length("text") > 0) & F.col("doc_id").isNotNull() & F.col("page_no").isNotNull()) \
        .withColumn("blk", F.floor(F.col("page_no") / block).cast("long"))
    pages = _fused_pages(pages).select(
        "at", "page_no", F.split("text", PARAGRAPH_BREAK, -1).alias("pieces"),
        is_blank("text").alias("blank"), breaks(text).cast("long").alias("nl"),
        (F.length("text") - F.length(F.ltrim(text, F.lit(WS_CHARS)))).alias("head"),
        F.length(F.rtrim(text, F.lit(WS_CHARS))).alias("body"), "text")
    pages = pages.select(
        "at", "page_no", "pieces", "blank", "nl",
        breaks(F.substring(text, 1, F.col("head"))).alias("lead"),
        breaks(F.substring(text, F.col("body") + 1, F.length("text"))).alias("trail"),
        is_blank(F.element_at("pieces", 1)).alias("open_blank"),
        # paragraphs that start behind a break of the page itself
        (F.size("pieces") - 1 - F.when((F.size("pieces") > 1) & is_blank(F.element_at("pieces", -1)), 1).otherwise(0)).alias("starts"))

    def running(keys: list, order: str):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def upto(df: DataFrame, keys: list, order: str, lead: str, last: str, total: str) -> DataFrame:
        """Adds ``gap``: line breaks between the last character before this row and
        its first; null where no character comes before it."""
        w = running(keys, order)
        df = df.withColumn("__before", F.coalesce(F.sum(total).over(w), F.lit(0)))
        df = df.withColumn("__last", F.max(F.col("__before") + F.col(last)).over(w))
        return df.withColumn("gap", F.col("__before") + F.col(lead) - F.col("__last"))

    end = F.when(~F.col("blank"), F.col("nl") - F.col("trail"))
    pages = upto(pages.withColumn("end", end), ["at"], "page_no", "lead", "end", "nl")
    inside = ~F.col("blank") & ~F.col("open_blank")
    pages = pages.withColumns({
        "first": F.when(inside & (F.col("gap") >= 2), 1).otherwise(0),
        # the first page of a block with text: whether it starts a paragraph depends on the blocks before
        "entry": ~F.col("blank") & F.col("gap").isNull(), "inside": inside})
    whole_block = Window.partitionBy("at")
    pages = pages.withColumns({
        "started": F.coalesce(F.sum(F.col("starts") + F.col("first")).over(running(["at"], "page_no")), F.lit(0)),
        "open": F.max(F.when(F.col("entry"), F.col("inside"))).over(whole_block),
        "alone": F.count(F.lit(1)).over(whole_block) == 1})
    # read three times below: cut once
    at = ["doc_id", "blk"]
    pages = materialize(pages.select("at.*", "page_no", "pieces", "nl", "lead", "starts", "first", "entry", "started", "open", "alone", "end",
                                     "__before", F.col("__last").isNull().alias("heads")), "page-pieces")

    # only blocks of documents with several depend on others
    blocks = pages.groupBy(*at).agg(
        F.sum("nl").alias("nl"), F.max(F.col("__before") + F.col("end")).alias("end"),
        F.max(F.when(F.col("entry"), F.col("__before") + F.col("lead"))).alias("lead"),
        F.max("open").alias("open"), F.sum(F.col("starts") + F.col("first")).alias("starts"))
    blocks = blocks.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where("n > 1")
    blocks = upto(blocks, ["doc_id"], "blk", "lead", "end", "nl")
    blocks = blocks.withColumn("enters", F.when(F.col("open") & (F.col("gap").isNull() | (F.col("gap") >= 2)), 1).otherwise(0))
    blocks = materialize(blocks.select(*at, "enters", F.coalesce(
        F.sum(F.col("starts") + F.col("enters")).over(running(["doc_id"], "blk")), F.lit(0)).alias("base")), "page-blocks", compact=True)

    placed = pages.join(blocks, at, "left")
    enters = F.coalesce("enters", F.when(F.col("open"), 1).otherwise(0))
    first = F.when(F.col("entry"), enters).otherwise(F.col("first"))
    earlier = F.when(F.col("entry") | F.col("heads"), 0).otherwise(enters)
    placed = placed.select(
        "doc_id", "page_no", "pieces", F.size("pieces").alias("n"), (F.col("alone") & F.col("base").isNull()).alias("all"),
        (F.coalesce("base", F.lit(0)) + F.col("started") + earlier + first - 1).alias("open_no"))
    para_no = (F.col("open_no") + F.col("at")).cast("int").alias("para_no")
    # rows are reflowed before they are exploded: a filter would repeat the expressions
    whole = placed.select("all", "n", "open_no", "doc_id", F.posexplode(_reflowed(F.col("pieces"))).alias("at", "text")) \
        .where(F.col("all") | ((F.col("at") > 0) & (F.col("at") < F.col("n") - 1)))
    whole = whole.where(F.col("open_no") + F.col("at") >= 0).select("doc_id", para_no, "text")
    ends = F.array_distinct(F.array(F.lit(0), F.col("n") - 1))
    edges = placed.where(~F.col("all")).select("doc_id", "page_no", "open_no", F.inline(F.transform(
        ends, lambda i: F.struct(i.alias("at"), F.get("pieces", i).alias("piece")))))
    edges = edges.select("doc_id", "page_no", "at", "piece", para_no)
    # behind a break, a blank piece belongs to nothing; before one it may hold the spaces of a line
    edges = edges.where((F.col("para_no") >= 0) & ((F.col("at") == 0) | ~is_blank("piece"))).groupBy("doc_id", "para_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "at", "piece"))),
                                 lambda s: s["piece"]), "").alias("text"))
    edges = edges.select("doc_id", "para_no", F.explode(_reflowed(F.array("text"))).alias("text"))
    # blank pieces behind a paragraph that is whole already stand alone: they are nothing
    return whole.unionByName(edges).where(F.length("text") > 0)


def kept_paragraphs(paragraphs: DataFrame, text_col: str = "text") -> DataFrame:
    """T7 on passage rows: cleaned, those longer than 30 characters kept."""
    return paragraphs.select(*[c for c in paragraphs.columns if c != text_col],
                             F.explode(clean_and_filter(F.array(text_col))).alias(text_col))
