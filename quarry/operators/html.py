"""HTML pages to passage text: T1 (paragraph elements) and T2 (full text).

Row-local and shuffle-free: a page is tokenised with one regular expression,
the ``<p>`` element spans come from one ``aggregate`` fold over its tags that
keeps the open-element stack, and each span's text is the text tokens inside
it. The stack rules follow a non-fixing HTML tree builder: an unclosed
``<p>`` stays open (so an outer paragraph repeats the inner ones), an end tag
closes the most recent open element of its name and everything opened after
it, an end tag with no open element is ignored, void and self-closed elements
hold nothing, script and style content is dropped, comments are not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import unescape_each
from ..functions.text import as_col, py_strip, splitlines

# Elements that never have content (HTML void elements plus
# obsolete ones a tree builder treats the same way).
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
                 "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
                 "command", "frame", "image", "isindex", "nextid", "spacer"]

# Paragraph rules of the HTML path.
P_MIN_CHARS = 20             # keep a <p> text longer than this
FULLTEXT_PHRASE_SPLIT = "  " # the no-<p> fallback also splits lines on two spaces

TOKEN_RE = (r"(?is)<script\b.*?</script\s*>|<script\b.*|<style\b.*?</style\s*>|<style\b.*"
            r"|<!--.*?-->|<![^>]*>|</?[a-z](?>\"[^\"]*\"|'[^']*'|[^'\">]++)*+>|[^<]+|<")
TAG_NAME_RE = r"^</?([A-Za-z][^\s/>]*)"
# joins text tokens: '<' cannot be part of a character reference, the
# private-use mark makes the pair unique; removed after decoding
JOIN_MARK = "<\ue000"
MARK_BYTES = len(JOIN_MARK.encode())


def tokens(html) -> Column:
    """``array<struct<i, tok, kind, tag, closing>>``: kind is 'text', 'tag'
    (non-void, not self-closed), 'p_self' (``<p/>``) or 'skip'."""
    toks = F.regexp_extract_all(as_col(html), F.lit(TOKEN_RE), 0)
    # first pass: the tag name once per token (a lambda body is interpreted,
    # so a name used three times would be extracted three times)
    named = F.transform(toks, lambda tok, i: F.struct(
        i.alias("i"), tok.alias("tok"),
        F.lower(F.regexp_extract(tok, TAG_NAME_RE, 1)).alias("name")))

    def classify(t):
        tok, name = t["tok"], t["name"]
        is_markup = tok.startswith("<") & (tok != "<")
        special = tok.rlike(r"^(?i)<(script|style)\b|^<!")
        closing = tok.startswith("</")
        self_closed = ~closing & tok.endswith("/>")
        kind = F.when(~is_markup, F.lit("text")) \
            .when(special, F.lit("skip")) \
            .when(name.isin(*VOID_ELEMENTS), F.lit("skip")) \
            .when(self_closed & (name == "p"), F.lit("p_self")) \
            .when(self_closed, F.lit("skip")) \
            .otherwise(F.lit("tag"))
        return F.struct(t["i"].alias("i"), tok.alias("tok"), kind.alias("kind"),
                        name.alias("tag"), closing.alias("closing"))

    return F.transform(named, classify)


def p_spans(toks: Column) -> Column:
    """``array<struct<pos, lo, hi>>`` of every ``<p>`` element in document order: token
    index of its start tag, and where its text starts and ends in bytes, when every
    text token is followed by ``JOIN_MARK``. One fold with the stack of open elements."""
    start = F.struct(
        F.array().cast("array<struct<tag:string,i:int,at:int>>").alias("st"),
        # ended elements as text: an array would be copied struct by struct at every end tag
        F.lit("").alias("out"), F.lit(0).alias("n"))

    def noted(elements, hi):
        return F.array_join(F.transform(F.filter(elements, lambda x: x["tag"] == "p"), lambda x: F.concat_ws(
            ",", x["i"].cast("string"), x["at"].cast("string"), hi.cast("string"))), ";")

    def step(acc, t):
        st, n = acc["st"], acc["n"]
        is_tag = t["kind"] == "tag"
        size = F.size(st)
        # only an end tag looks for its element
        back = F.when(is_tag & t["closing"], F.array_position(F.reverse(F.transform(st, lambda x: x["tag"])), t["tag"])).otherwise(0)
        at = (size - back + 1).cast("int")
        closes = back > 0
        popped = F.slice(st, at, (size - at + 1).cast("int"))
        new_st = F.when(is_tag & ~t["closing"], F.concat(st, F.array(F.struct(
            t["tag"].alias("tag"), t["i"].alias("i"), n.alias("at"))))) \
            .when(closes, F.slice(st, 1, (at - 1).cast("int"))).otherwise(st)
        new_out = F.when(closes & F.exists(popped, lambda x: x["tag"] == "p"),
                         F.concat(acc["out"], F.lit(";"), noted(popped, n))).otherwise(acc["out"])
        new_n = F.when(t["kind"] == "text", n + F.octet_length(t["tok"]) + MARK_BYTES).otherwise(n)
        return F.struct(new_st.alias("st"), new_out.alias("out"), new_n.alias("n"))

    def finish(acc):
        found = F.split(F.concat(acc["out"], F.lit(";"), noted(acc["st"], acc["n"])), ";")
        numbers = F.transform(F.filter(found, lambda x: x != ""), lambda x: F.split(x, ",").cast("array<int>"))
        return F.array_sort(F.transform(numbers, lambda x: F.struct(x[0].alias("pos"), x[1].alias("lo"), x[2].alias("hi"))))

    return F.aggregate(toks, start, step, finish)


def _span_texts(whole: Column, spans: Column) -> Column:
    """The text of each span: one cut of the page's text, marks inside kept."""
    # a lambda's body is evaluated for every element: what it reads is bound once before
    bound = F.array(F.struct(F.concat(whole, F.lit(JOIN_MARK)).cast("binary").alias("text"), spans.alias("spans")))
    return F.element_at(F.transform(bound, lambda b: F.transform(b["spans"], lambda sp: F.substring(
        b["text"], sp["lo"] + 1, F.greatest(sp["hi"] - sp["lo"] - MARK_BYTES, F.lit(0))).cast("string"))), 1)


def _text_tokens(toks: Column) -> Column:
    return F.filter(toks, lambda t: t["kind"] == "text")


def _split_phrases(text: Column) -> Column:
    """T2 line rules: lines stripped, split on two spaces, pieces stripped,
    empty pieces dropped, joined by newlines."""
    lines = F.transform(splitlines(text), py_strip)
    phrases = F.transform(F.flatten(F.transform(
        lines, lambda ln: F.split(ln, FULLTEXT_PHRASE_SPLIT, -1))), py_strip)
    return F.array_join(F.filter(phrases, lambda p: F.length(p) > 0), "\n")


def with_html_text(df: DataFrame, html: str, out: str = "text") -> DataFrame:
    """T1 + T2 + F4 as a chain of projections over a pages table.

    ``out`` = the ``<p>`` texts (decoded, stripped, longer than 20 characters,
    nested ones included, document order) joined by blank lines; for a page
    with no ``<p>`` element at all, its full text by the T2 rules. The page
    is tokenised once; only texts containing '&' visit Python for decoding.
    """
    tok, has_p, raw, dec = (f"__{out}_{n}" for n in ("tok", "has_p", "raw", "dec"))
    d = df.withColumn(tok, tokens(html))
    d = d.withColumn(has_p, F.exists(tok, lambda t: (t["tag"] == "p") & ~t["closing"]
                                     & t["kind"].isin("tag", "p_self")))
    whole = F.array_join(F.transform(_text_tokens(F.col(tok)), lambda x: x["tok"]), JOIN_MARK)
    per_span = _span_texts(whole, p_spans(F.col(tok)))
    d = d.withColumn(raw, F.when(F.col(has_p), per_span).otherwise(F.array(whole))).drop(tok)
    d = d.withColumn(dec, unescape_each(F.col(raw))).drop(raw)
    unmarked = F.transform(dec, lambda s: F.replace(s, F.lit(JOIN_MARK), F.lit("")))
    paragraphs = F.array_join(F.filter(F.transform(unmarked, py_strip),
                                       lambda s: F.length(s) > P_MIN_CHARS), "\n\n")
    return d.withColumn(out, F.when(F.col(has_p), paragraphs)
                        .otherwise(_split_phrases(F.element_at(unmarked, 1)))).drop(has_p, dec)
