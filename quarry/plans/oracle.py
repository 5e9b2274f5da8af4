"""DuckDB SQL that computes the same tables as ``quarry.plans.queries``.

Written from the rules themselves (joined texts, list lambdas, recursive
CTEs), not from the Spark plans, so a match checks the rules twice. Regex
classes are spelled out because RE2's ``\\s`` and ``\\d`` are ASCII-only.
"""

from __future__ import annotations

from ..functions.text import WS
from .replay import ANSWERS, SAMPLES, sql_pick
from .rules import LENGTHY, SCREEN, VERIFY, sql_rule

# The two prompts, as whole texts of their own.
PROMPT_SHORT = """Does a segment of this text match the following criteria:
```
{criterion}
```
Please answer with "1" if it matches, "0" if it does not. You must answer with one of the two. If unsure, put 1.

Text: \"\"\"{text}\"\"\""""
PROMPT_FINAL = """Does a segment of this text match the following criteria:
```
{criterion}
```
If it matches, respond in this JSON format (do not add any commentary or extra text):
{
    "verdict": 1,
    "excerpt": "Write out all relevant text from the segment, including both context and the main match.",
    "explanation": "Write a brief 1-sentence explanation of what you found."
}
If it does not match, respond with:
{
    "verdict": 0
}

Text: \"\"\"{text}\"\"\""""


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"

STRIP = f"'^{WS}+|{WS}+\\z'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{WS}+', ' ', 'g')"


def _clean(x: str) -> str:
    c = _collapse(x)
    return f"(CASE WHEN regexp_matches({c}, '^\\p{{Nd}}+{WS}*$') THEN '' ELSE {c} END)"


def _is_upper(x: str) -> str:
    return f"(regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def _stanzas(x: str) -> str:
    lines = "string_split(s, chr(10))"
    heading = f"(len({lines}) <= 2 AND len(list_filter({lines}, lambda l: {_is_upper('l')})) > 0)"
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '\\n{WS}*\\n'), "
            f"lambda y: {_strip('y')}), lambda s: length(s) >= 50 AND NOT {heading})")


def _paragraphs(x: str) -> str:
    by_blank = f"regexp_split_to_array({x}, '\\n{WS}*\\n+')"
    pieces = f"(CASE WHEN len({by_blank}) < 10 THEN string_split({x}, chr(10)) ELSE {by_blank} END)"
    return f"list_filter(list_transform({pieces}, lambda y: {_clean('y')}), lambda c: length(c) > 30)"


def _numbered(src: str, key: str = "doc_id", arr: str = "arr", text: str = "text") -> str:
    return (f"SELECT {key}, CAST(i - 1 AS INTEGER) AS passage_no, {arr}[i] AS {text} "
            f"FROM (SELECT {key}, {arr}, generate_subscripts({arr}, 1) AS i FROM {src})")


CONV_TEXT = """(SELECT conv_id AS doc_id,
        string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS txt
   FROM conversations GROUP BY conv_id)"""

TXT_STANZAS = _numbered(f"(SELECT doc_id, {_stanzas('txt')} AS arr FROM {CONV_TEXT})")

PARAGRAPHS_FALLBACK = _numbered(f"(SELECT doc_id, {_paragraphs('text')} AS arr FROM documents)")


def _after_think(s: str) -> str:
    return _strip(f"string_split({s}, '</think>')[-1]")


def _final_answer(x: str) -> str:
    s = _strip(x)
    return (f"(CASE WHEN contains({s}, '</think>') THEN {_after_think(s)} "
            f"WHEN contains({s}, '<think>') THEN NULL ELSE {s} END)")


def _sample_answer(x: str) -> str:
    s = _strip(x)
    return f"(CASE WHEN contains({s}, '</think>') THEN {_after_think(s)} ELSE {s} END)"


def _verdict_cols(ans: str, final: str) -> str:
    """Columns clear, label, confidence, explanation from an answer."""
    js = f"regexp_extract({ans}, '(?s)\\{{.*\\}}', 0)"
    ok = f"({js} <> '' AND coalesce(json_valid({js}), false))"
    exc = f"coalesce(json_extract_string({js}, '$.excerpt'), '')"
    why = f"coalesce(json_extract_string({js}, '$.explanation'), '')"
    combined = _strip(f"({exc} || chr(10) || chr(10) || 'Explanation: ' || {why})")
    code = f"""(CASE
        WHEN {final} AND {ok} AND coalesce(json_extract_string({js}, '$.verdict'), '0') = '1' THEN 'J1'
        WHEN {final} AND {ok} THEN 'J0'
        WHEN {ans} IS NULL THEN 'U'
        WHEN starts_with({ans}, '1:') THEN 'P1'
        WHEN {ans} = '1' THEN 'E1'
        WHEN {ans} = '0' THEN 'E0'
        WHEN contains({ans}, '1') AND NOT contains({ans}, '0') THEN 'L1'
        WHEN contains({ans}, '0') AND NOT contains({ans}, '1') THEN 'L0'
        ELSE 'U' END)"""
    return f"""{code} <> 'U' AS clear,
      CASE WHEN {code} IN ('J1', 'P1', 'E1', 'L1') THEN '1'
           WHEN {code} IN ('J0', 'E0', 'L0') THEN '0' END AS label,
      CAST(CASE WHEN {code} IN ('J1', 'J0', 'P1', 'E1', 'E0') THEN 0.95
                WHEN {code} IN ('L1', 'L0') THEN 0.85 END AS DOUBLE) AS confidence,
      CASE WHEN {code} = 'J1' THEN {combined}
           WHEN {code} = 'P1' THEN {_strip(f'substring({ans}, 3)')}
           WHEN {code} IN ('E1', 'L1') THEN 'Match detected.'
           WHEN {code} IN ('J0', 'E0', 'L0') THEN '' END AS explanation"""


PARSE_VERDICTS = f"""
WITH r AS (
  SELECT doc_id, m AS model_idx, {sql_pick(ANSWERS, 'doc_id * 7 + m * 3')} AS raw
  FROM labels, (SELECT unnest([0, 1]) AS m) AS models
), a AS (SELECT *, {_final_answer('raw')} AS ans FROM r)
SELECT doc_id, model_idx, raw, {_verdict_cols('ans', 'model_idx = 1')} FROM a"""

RESOLVE_ATTEMPTS = f"""
WITH r AS (
  SELECT doc_id, m AS model_idx, t AS attempt,
         {sql_pick(ANSWERS, 'doc_id * 5 + m * 11 + t * 13')} AS raw
  FROM labels, (SELECT unnest([0, 1]) AS m) AS models, (SELECT unnest([1, 2, 3]) AS t) AS tries
), a AS (SELECT *, {_final_answer('raw')} AS ans FROM r),
v AS (SELECT doc_id, model_idx, attempt, {_verdict_cols('ans', 'model_idx = 1')} FROM a)
SELECT doc_id, model_idx,
       min(attempt) FILTER (WHERE clear) AS attempt,
       arg_min(label, attempt) FILTER (WHERE clear) AS label,
       arg_min(confidence, attempt) FILTER (WHERE clear) AS confidence,
       arg_min(explanation, attempt) FILTER (WHERE clear) AS explanation,
       CASE WHEN bool_or(clear) THEN 'clear' ELSE 'unresolved' END AS status
FROM v GROUP BY doc_id, model_idx"""

VOTE_RESOLUTION = f"""
WITH r AS (
  SELECT doc_id, lab AS label, n AS sample_no,
         {sql_pick(SAMPLES, "doc_id * 3 + n * 5 + CASE WHEN lab = '1' THEN 7 ELSE 0 END")} AS raw
  FROM labels, (SELECT unnest(['1', '0']) AS lab) AS l, (SELECT unnest([1, 2, 3, 4, 5]) AS n) AS s
), h AS (
  SELECT doc_id, label, CAST(contains({_sample_answer('raw')}, label) AS INTEGER) AS hit FROM r
), sh AS (
  SELECT doc_id,
         CAST(sum(hit) FILTER (WHERE label = '1') AS DOUBLE) / count(*) FILTER (WHERE label = '1') AS p,
         CAST(sum(hit) FILTER (WHERE label = '0') AS DOUBLE) / count(*) FILTER (WHERE label = '0') AS n
  FROM h GROUP BY doc_id
)
SELECT doc_id,
       CASE WHEN p + n <= 0 THEN '0' WHEN p / (p + n) > n / (p + n) THEN '1' ELSE '0' END AS label,
       CASE WHEN p + n <= 0 THEN 0.0 WHEN p / (p + n) > n / (p + n) THEN p / (p + n)
            ELSE n / (p + n) END AS confidence,
       CASE WHEN p + n > 0 AND p / (p + n) > n / (p + n) THEN 'Match detected.' ELSE '' END AS explanation,
       CASE WHEN p + n <= 0 THEN 'error' ELSE 'vote' END AS status
FROM sh"""


def _trail(k: int, n: int, outcome: str) -> str:
    if outcome == "accepted":
        steps = [f"Model {i + 1}: 1" for i in range(n)]
        return "'" + " | ".join(steps) + f" | → All {n} approved'"
    steps = [f"Model {i + 1}: 1" for i in range(k)] + [f"Model {k + 1}: 0"]
    return "'" + " | ".join(steps) + (" → rejected'" if outcome == "rejected" else " → error'")


def rule_cascade_sql(passages_sql: str, judges: list, keys: list[str],
                     carry: list[str] = (), single_model_final: bool = False) -> str:
    """A cascade of rule judges in SQL: one CTE chain per stage, terminal
    rows of every stage unioned."""
    n = len(judges)
    k_cols = ", ".join(keys)
    carry_cols = "".join(f", {c}" for c in carry)
    ctes = [f"p0 AS ({passages_sql})"]
    outs = []
    for k, table in enumerate(judges):
        final = "true" if (k == n - 1 and (n > 1 or single_model_final)) else "false"
        src = f"p{k}"
        ctes.append(f"""r{k} AS (
  SELECT {k_cols}, text, {sql_rule(table, 'text')} AS raw FROM {src})""")
        ctes.append(f"""a{k} AS (
  SELECT *, {_final_answer('raw')} AS ans, {_sample_answer('raw')} AS sa FROM r{k})""")
        ctes.append(f"""v{k} AS (
  SELECT {k_cols}, text, CAST(contains(sa, '1') AS DOUBLE) AS pos,
         CAST(contains(sa, '0') AS DOUBLE) AS neg, {_verdict_cols('ans', final)} FROM a{k})""")
        vp = "(pos + neg > 0 AND pos / (pos + neg) > neg / (pos + neg))"
        ctes.append(f"""s{k} AS (
  SELECT {k_cols}, text,
    CASE WHEN clear THEN label WHEN {vp} THEN '1' ELSE '0' END AS label,
    CASE WHEN clear THEN confidence WHEN pos + neg <= 0 THEN 0.0
         WHEN {vp} THEN pos / (pos + neg) ELSE neg / (pos + neg) END AS confidence,
    CASE WHEN clear THEN explanation WHEN {vp} THEN 'Match detected.' ELSE '' END AS explanation,
    CASE WHEN clear THEN 'clear' WHEN pos + neg <= 0 THEN 'error' ELSE 'vote' END AS status
  FROM v{k})""")
        outs.append(f"""SELECT {k_cols}{carry_cols}, '0' AS label,
    CASE WHEN status = 'error' THEN 0.0 ELSE confidence END AS confidence, '' AS explanation,
    CASE WHEN status = 'error' THEN {_trail(k, n, 'error')} ELSE {_trail(k, n, 'rejected')} END
      AS cascade_info,
    CASE WHEN status = 'error' THEN 'error' ELSE 'rejected' END AS status,
    confidence AS model_confidence
  FROM s{k} WHERE label <> '1' OR status = 'error'""")
        if k < n - 1:
            ctes.append(f"p{k + 1} AS (SELECT {k_cols}, text FROM s{k} "
                        f"WHERE label = '1' AND status <> 'error')")
    last = n - 1
    outs.append(f"""SELECT {k_cols}{carry_cols}, '1' AS label, CAST(0.95 AS DOUBLE) AS confidence,
    explanation, {_trail(last, n, 'accepted')} AS cascade_info, 'accepted' AS status,
    confidence AS model_confidence
  FROM s{last} WHERE label = '1' AND status <> 'error'""")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(outs)


CASCADE_RULE = rule_cascade_sql(TXT_STANZAS, [SCREEN, VERIFY], ["doc_id", "passage_no"])

ORDERED_RESULTS = f"SELECT * FROM ({CASCADE_RULE}) ORDER BY doc_id, passage_no"

CASCADE_TRAIL = f"""
SELECT cascade_info, status, count(*) AS passages,
       CAST(sum(CASE WHEN label = '1' THEN 1 ELSE 0 END) AS BIGINT) AS found
FROM ({rule_cascade_sql(PARAGRAPHS_FALLBACK, [SCREEN, LENGTHY, VERIFY], ["doc_id", "passage_no"])})
GROUP BY cascade_info, status"""

_FOUND = f"""SELECT * FROM ({rule_cascade_sql(TXT_STANZAS, [SCREEN, VERIFY], ["doc_id", "passage_no"],
                                               carry=["text"])}) WHERE label = '1'"""

FINDINGS = f"""
SELECT 0 AS run_id, doc_id, passage_no, finding_no, confidence, explanation,
       '"' || text || '"' AS raw_quote,
       CASE WHEN length(explanation) > 0 THEN
         'Finding #' || finding_no || ' (Paragraph ' || (passage_no + 1) || ', Confidence: '
         || printf('%.2f', confidence) || ')' || chr(10) || repeat('-', 60) || chr(10)
         || 'Explanation: ' || explanation || chr(10) || chr(10) || text || chr(10) || chr(10)
       END AS detail
FROM (SELECT *, row_number() OVER (ORDER BY doc_id, passage_no) AS finding_no FROM ({_FOUND}))"""

RUN_TOTALS = f"""
SELECT 0 AS run_id, count(*) AS processed,
       count(*) FILTER (WHERE label = '1') AS found,
       CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE label = '1') AS DOUBLE) * 100.0
            / count(*) END AS success_rate
FROM ({CASCADE_RULE})"""

RECENT_RESULTS = f"""
SELECT * FROM (SELECT doc_id, passage_no, label, confidence, cascade_info FROM ({CASCADE_RULE})
               ORDER BY doc_id DESC, passage_no DESC LIMIT 8)"""

NEXT_RUN = "SELECT coalesce(max(doc_id), -1) + 1 AS next_run_id FROM labels"


COMPLETED_RANGES = """
SELECT min(doc_id) AS lo, max(doc_id) AS hi
FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g
      FROM (SELECT DISTINCT doc_id FROM labels))
GROUP BY g"""

EXPANDED_RANGES = """
SELECT doc_id, unnest(generate_series(doc_id, doc_id + quality + 2 * toxic)) AS n FROM labels"""

_DONE = """(SELECT doc_id, CAST(unnest(generate_series(0, quality + toxic)) AS INTEGER) AS passage_no
   FROM labels)"""

PENDING_PASSAGES = f"""
SELECT s.* FROM ({TXT_STANZAS}) s
WHERE NOT EXISTS (SELECT 1 FROM {_DONE} d WHERE d.doc_id = s.doc_id AND d.passage_no = s.passage_no)"""

PROGRESS_STATE = f"""
WITH s AS ({TXT_STANZAS}),
d AS (SELECT DISTINCT d.doc_id, d.passage_no FROM {_DONE} d
      JOIN s ON d.doc_id = s.doc_id AND d.passage_no = s.passage_no)
SELECT s.doc_id, count(*) AS total,
       count(d.passage_no) AS completed,
       count(*) - count(d.passage_no) AS remaining,
       max(d.passage_no) + 1 AS resume_from
FROM s LEFT JOIN d ON s.doc_id = d.doc_id AND s.passage_no = d.passage_no
GROUP BY s.doc_id"""

_JOBS = """(SELECT source AS job_id,
   CASE min(lang) WHEN 'de' THEN ['screen', 'verify'] WHEN 'en' THEN ['screen', 'lengthy', 'verify']
        WHEN 'es' THEN ['screen', 'oracle-x'] ELSE CAST([] AS VARCHAR[]) END AS model_names,
   source || CASE min(lang) WHEN 'de' THEN '.pdf' WHEN 'en' THEN '.txt' WHEN 'es' THEN '.HTML'
        ELSE '.htm' END AS target_file,
   CASE WHEN min(n_chars) < 10 THEN '  ' ELSE 'a sentence in ' || min(lang) END AS search_criteria
 FROM documents GROUP BY source)"""


def _validated(jobs: str) -> str:
    suffix = "lower(regexp_extract(regexp_extract(target_file, '([^/]*)$', 1), '[^.](\\.[^.]+)$', 1))"
    missing = ("list_filter([CASE WHEN model_names IS NULL THEN 'model_names' END, "
               "CASE WHEN target_file IS NULL THEN 'target_file' END, "
               "CASE WHEN search_criteria IS NULL THEN 'search_criteria' END], lambda x: x IS NOT NULL)")
    blank = (f"list_filter([CASE WHEN model_names IS NOT NULL AND len(model_names) = 0 THEN 'model_names' END, "
             f"CASE WHEN target_file IS NOT NULL AND length({_strip('target_file')}) = 0 THEN 'target_file' END, "
             f"CASE WHEN search_criteria IS NOT NULL AND length({_strip('search_criteria')}) = 0 "
             f"THEN 'search_criteria' END], lambda x: x IS NOT NULL)")
    unknown = "list_filter(coalesce(model_names, []), lambda m: NOT list_contains(['screen', 'lengthy', 'verify'], m))"
    problems = (f"list_filter(["
                f"CASE WHEN len({missing}) > 0 THEN 'missing: ' || array_to_string({missing}, ', ') END, "
                f"CASE WHEN len({blank}) > 0 THEN 'empty: ' || array_to_string({blank}, ', ') END, "
                f"CASE WHEN len({unknown}) > 0 THEN 'unknown models: ' || array_to_string({unknown}, ', ') END, "
                f"CASE WHEN target_file IS NOT NULL AND length({_strip('target_file')}) > 0 "
                f"AND {suffix} NOT IN ('.html', '.txt', '.pdf') THEN 'unsupported type: ' || {suffix} END"
                f"], lambda x: x IS NOT NULL)")
    return (f"(SELECT job_id, search_criteria, len({problems}) = 0 AS valid, "
            f"array_to_string({problems}, '; ') AS problems FROM {jobs})")


VALIDATE_JOBS = f"SELECT job_id, valid, problems FROM {_validated(_JOBS)}"


def _prompt(criterion: str, text: str, final: bool) -> str:
    before, _, rest = (PROMPT_FINAL if final else PROMPT_SHORT).partition("{criterion}")
    between, _, after = rest.partition("{text}")
    return f"({_lit(before)} || {criterion} || {_lit(between)} || {text} || {_lit(after)})"


BUILD_PROMPTS = f"""
WITH p AS ({_numbered(f"(SELECT doc_id, {_paragraphs('text')} AS arr FROM documents)")}),
j AS (SELECT job_id, search_criteria FROM {_validated(_JOBS)} WHERE valid)
SELECT p.doc_id, p.passage_no, j.job_id,
       {_prompt('j.search_criteria', 'p.text', False)} AS prompt_short,
       {_prompt('j.search_criteria', 'p.text', True)} AS prompt_final
FROM p JOIN documents d ON d.doc_id = p.doc_id JOIN j ON j.job_id = d.source"""


def _packed(paras: str) -> str:
    """T10 by recursion over passage numbers: a chunk closes after the
    passage that brings its count (length + 2 each) to 1600."""
    return f"""WITH RECURSIVE p AS ({paras}),
w AS (SELECT doc_id, passage_no, text, length(text) + 2 AS w FROM p),
r AS (
  SELECT doc_id, passage_no, 0 AS chunk, w AS acc FROM w WHERE passage_no = 0
  UNION ALL
  SELECT w.doc_id, w.passage_no,
         CASE WHEN r.acc >= 1600 THEN r.chunk + 1 ELSE r.chunk END,
         CASE WHEN r.acc >= 1600 THEN w.w ELSE r.acc + w.w END
  FROM r JOIN w ON w.doc_id = r.doc_id AND w.passage_no = r.passage_no + 1
)
SELECT r.doc_id, CAST(r.chunk AS INTEGER) AS passage_no,
       string_agg(w.text, chr(10) || chr(10) ORDER BY w.passage_no) AS text
FROM r JOIN w ON w.doc_id = r.doc_id AND w.passage_no = r.passage_no
GROUP BY r.doc_id, r.chunk"""


PACK_CHUNKS = _packed(PARAGRAPHS_FALLBACK)

_PAGES = """(SELECT doc_id, page_no, substring(text, page_no * 700 + 1, 700) AS text
   FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / 700) AS BIGINT) - 1)) AS page_no
         FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) AS text FROM documents)
         WHERE length(text) > 0))"""

_REFLOWED = f"""(WITH joined AS (
  SELECT doc_id, string_agg(text, '' ORDER BY page_no) AS txt FROM {_PAGES}
  WHERE length(text) > 0 GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(txt, chr(10))) AS line,
         unnest(generate_series(1, len(string_split(txt, chr(10))))) AS idx FROM joined),
flagged AS (
  SELECT *, CASE WHEN length({_strip('line')}) = 0 THEN 1 ELSE 0 END AS blank FROM lines),
grouped AS (
  SELECT *, sum(blank) OVER (PARTITION BY doc_id ORDER BY idx) AS para FROM flagged),
paras AS (
  SELECT doc_id, para, {_strip(f"string_agg({_strip('line')}, ' ' ORDER BY idx)")} AS text
  FROM grouped WHERE blank = 0 GROUP BY doc_id, para)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS INTEGER) AS para_no,
       text FROM paras)"""

REFLOW_PAGES = f"SELECT * FROM {_REFLOWED}"

PDF_CHUNKS = _packed(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_no) - 1
        AS INTEGER) AS passage_no, text
   FROM (SELECT doc_id, para_no, {_clean('text')} AS text FROM {_REFLOWED})
   WHERE length(text) > 30""")


def _token_re_sql() -> str:
    # RE2 runs in linear time and knows no possessive groups: a pattern of its own
    tag = r"""</?[a-z](?:"[^"]*"|'[^']*'|[^'">])*>"""
    dropped = "|".join(rf"<{t}\b.*?</{t}\s*>|<{t}\b.*" for t in ("script", "style"))
    return _lit(rf"(?is){dropped}|<!--.*?-->|<![^>]*>|{tag}|[^<]+|<")


# Entities the fixture pages hold inside paragraphs, decoded per text token
# ('&amp;' last so that an escaped reference is not decoded twice).
_ENTITY_REPLACE = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _decode(x: str) -> str:
    for ent, ch in _ENTITY_REPLACE:
        x = f"replace({x}, {_lit(ent)}, {_lit(ch)})"
    return x


#: Python's line breaks.
_BREAKS = _lit(r"\r\n|[\n\r\x{0B}\f\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]")


# Elements without content.
_VOID_SQL = """['area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'keygen', 'link', 'menuitem', 'meta',
 'param', 'source', 'track', 'wbr', 'basefont', 'bgsound', 'command', 'frame', 'image', 'isindex', 'nextid', 'spacer']"""

HTML_PARAGRAPHS = f"""
WITH RECURSIVE toks AS (
  SELECT page_id, tok, CAST(i - 1 AS INTEGER) AS i
  FROM (SELECT page_id, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS i
        FROM (SELECT page_id, regexp_extract_all(html, {_token_re_sql()}, 0) AS t FROM pages))
), cls AS (
  SELECT page_id, i, tok,
         lower(regexp_extract(tok, '^</?([A-Za-z][^\\s/>]*)', 1)) AS tag,
         starts_with(tok, '</') AS closing,
         CASE WHEN NOT starts_with(tok, '<') OR tok = '<' THEN 'text'
              WHEN regexp_matches(tok, '^(?i)<(script|style)\\b|^<!') THEN 'skip'
              WHEN list_contains({_VOID_SQL}, lower(regexp_extract(tok, '^</?([A-Za-z][^\\s/>]*)', 1))) THEN 'skip'
              WHEN NOT starts_with(tok, '</') AND ends_with(tok, '/>') THEN 'selfclosed'
              ELSE 'tag' END AS kind
  FROM toks
), tags AS (
  SELECT page_id, i, tag, closing, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k
  FROM cls WHERE kind = 'tag'
), walk(page_id, k, st, out) AS (
  SELECT page_id, 0, CAST([] AS STRUCT(tag VARCHAR, i INTEGER)[]),
         CAST([] AS STRUCT(pos INTEGER, e INTEGER)[]) FROM pages
  UNION ALL
  SELECT w.page_id, w.k + 1,
    CASE WHEN NOT t.closing THEN list_append(w.st, {{'tag': t.tag, 'i': t.i}})
         WHEN coalesce(list_position(list_reverse(list_transform(w.st, lambda x: x.tag)), t.tag), 0) > 0
         THEN list_slice(w.st, 1, len(w.st) - list_position(list_reverse(list_transform(w.st, lambda x: x.tag)), t.tag))
         ELSE w.st END,
    CASE WHEN t.closing AND coalesce(list_position(list_reverse(list_transform(w.st, lambda x: x.tag)), t.tag), 0) > 0
         THEN list_concat(w.out, list_transform(list_filter(
                list_slice(w.st, len(w.st) - list_position(list_reverse(list_transform(w.st, lambda x: x.tag)), t.tag) + 1, len(w.st)),
                lambda x: x.tag = 'p'), lambda x: {{'pos': x.i, 'e': t.i}}))
         ELSE w.out END
  FROM walk w JOIN tags t ON t.page_id = w.page_id AND t.k = w.k + 1
), last AS (
  SELECT page_id, list_concat(out, list_transform(list_filter(st, lambda x: x.tag = 'p'),
                                                 lambda x: {{'pos': x.i, 'e': 2147483647}})) AS spans
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k DESC) AS rn FROM walk) WHERE rn = 1
), spans AS (
  SELECT page_id, sp.pos AS pos, sp.e AS e FROM (SELECT page_id, unnest(spans) AS sp FROM last)
), ptext AS (
  SELECT s.page_id, s.pos,
         {_strip(f"coalesce(string_agg({_decode('c.tok')}, '' ORDER BY c.i), '')")} AS t
  FROM spans s LEFT JOIN cls c ON c.page_id = s.page_id AND c.kind = 'text' AND c.i > s.pos AND c.i < s.e
  GROUP BY s.page_id, s.pos
), page_text AS (
  SELECT page_id AS doc_id, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS text
  FROM ptext WHERE length(t) > 20 GROUP BY page_id
)
{_numbered(f"(SELECT doc_id, {_paragraphs('text')} AS arr FROM page_text)")}"""


# in document order, all text tokens of a page without paragraphs (a title may end in a bare &amp)
HTML_FULLTEXT = f"""
WITH toks AS (
  SELECT page_id, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS i
  FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?i)<(/?)p\\b', '<\\1div', 'g'), {_token_re_sql()}, 0) AS t FROM pages)
), full_text AS (
  SELECT page_id AS doc_id, string_agg(regexp_replace({_decode('tok')}, '&amp', '&', 'g'), '' ORDER BY i) AS t
  FROM toks WHERE NOT starts_with(tok, '<') OR tok = '<' GROUP BY page_id
), phrases AS (
  SELECT doc_id, list_filter(list_transform(flatten(list_transform(regexp_split_to_array(t, {_BREAKS}),
           lambda l: string_split({_strip('l')}, '  '))), lambda q: {_strip('q')}), lambda r: length(r) > 0) AS ps FROM full_text
)
{_numbered(f"(SELECT doc_id, {_paragraphs('txt')} AS arr FROM (SELECT doc_id, array_to_string(ps, chr(10)) AS txt FROM phrases))")}"""

EXTRACT_PASSAGES = f"""
SELECT *, doc_id || CASE content_type WHEN 'paragraphs' THEN '.html' WHEN 'stanzas' THEN '.txt' ELSE '.pdf' END
          || ':' || passage_no AS passage_key FROM (
SELECT doc_id, passage_no, 'paragraphs' AS content_type, text FROM ({HTML_PARAGRAPHS})
UNION ALL
SELECT doc_id, passage_no, 'stanzas' AS content_type, text
FROM ({_numbered(f"(SELECT doc_id, {_stanzas('text')} AS arr FROM documents)")})
UNION ALL
SELECT doc_id, passage_no, 'chunks' AS content_type, text FROM ({PDF_CHUNKS}))"""


def _report_lines(run: int, judges: list) -> str:
    """The lines of one run's two reports."""
    results = rule_cascade_sql(TXT_STANZAS, judges, ["doc_id", "passage_no"], carry=["text"])
    found = f"""(SELECT *, row_number() OVER (ORDER BY doc_id, passage_no) AS no FROM ({results}) WHERE label = '1')"""
    nl = "chr(10)"
    detail = f"""'Finding #' || no || ' (Paragraph ' || (passage_no + 1) || ', Confidence: ' || printf('%.2f', confidence) || ')'
      || {nl} || repeat('-', 60) || {nl} || 'Explanation: ' || explanation || {nl} || {nl} || text || {nl}"""
    ends = f"""'Matching Paragraphs Found' || {nl} || repeat('=', 50) || {nl} AS a,
      {nl} || repeat('=', 50) || {nl} || 'PROCESSING COMPLETE' || {nl} || repeat('=', 50) || {nl}
      || 'Total paragraphs processed: ' || count(*) || {nl} || 'Matches found: ' || count(*) FILTER (WHERE label = '1') || {nl}
      || CASE WHEN count(*) > 0 THEN 'Success rate: ' || printf('%.1f', 100.0 * count(*) FILTER (WHERE label = '1') / count(*)) || '%' || {nl}
              ELSE '' END AS b"""
    return f"""
SELECT {run} AS run_id, 'raw_quotes' AS report, unnest(string_split('"' || text || '"', {nl})) AS line FROM {found}
UNION ALL SELECT {run}, 'detailed_results', unnest(string_split({detail}, {nl})) FROM {found} WHERE length(explanation) > 0
UNION ALL SELECT {run}, 'detailed_results', unnest(string_split(v, {nl}))
  FROM (SELECT unnest([a, b]) AS v FROM (SELECT {ends} FROM ({results})))"""


STORED_REPORTS = f"""
SELECT run_id, report, line, count(*) AS n
FROM ({_report_lines(0, [SCREEN, VERIFY])} UNION ALL {_report_lines(1, [SCREEN])}) GROUP BY ALL"""


def _job_part(job: str, lang: str, judges: list) -> str:
    paras = _numbered(f"(SELECT '{job}' AS job_id, doc_id, {_paragraphs('text')} AS arr FROM documents WHERE lang = '{lang}')",
                      "job_id, doc_id")
    return f"SELECT * FROM ({rule_cascade_sql(paras, judges, ['job_id', 'doc_id', 'passage_no'])})"


JOB_CASCADE = "\nUNION ALL\n".join(_job_part(*x) for x in (
    ("de-0", "de", [SCREEN, VERIFY]), ("en-0", "en", [SCREEN, LENGTHY, VERIFY]), ("en-1", "en", [LENGTHY, SCREEN]),
    ("es-0", "es", [VERIFY]), ("fr-0", "fr", [LENGTHY, VERIFY])))


def sql() -> dict[str, str]:
    return {
        "txt_stanzas": TXT_STANZAS,
        "paragraphs_fallback": PARAGRAPHS_FALLBACK,
        "parse_verdicts": PARSE_VERDICTS,
        "resolve_attempts": RESOLVE_ATTEMPTS,
        "vote_resolution": VOTE_RESOLUTION,
        "cascade_rule": CASCADE_RULE,
        "ordered_results": ORDERED_RESULTS,
        "cascade_trail": CASCADE_TRAIL,
        "findings": FINDINGS,
        "stored_reports": STORED_REPORTS,
        "run_totals": RUN_TOTALS,
        "recent_results": RECENT_RESULTS,
        "next_run": NEXT_RUN,
        "completed_ranges": COMPLETED_RANGES,
        "expanded_ranges": EXPANDED_RANGES,
        "pending_passages": PENDING_PASSAGES,
        "pending_by_ranges": PENDING_PASSAGES,
        "resumed_passages": PENDING_PASSAGES,
        "progress_state": PROGRESS_STATE,
        "validate_jobs": VALIDATE_JOBS,
        "build_prompts": BUILD_PROMPTS,
        "job_cascade": JOB_CASCADE,
        "pack_chunks": PACK_CHUNKS,
        "reflow_pages": REFLOW_PAGES,
        "pdf_chunks": PDF_CHUNKS,
        "html_paragraphs": HTML_PARAGRAPHS,
        "html_fulltext": HTML_FULLTEXT,
        "extract_passages": EXTRACT_PASSAGES,
    }
