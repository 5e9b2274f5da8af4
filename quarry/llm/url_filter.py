"""Operator 6 [native]: URL filters by a path-template tree.

Rules decide the URLs they fit and label them for the method, which decides
the rest. Paths become segments; a segment that is a number or a long
hexadecimal or encoded word turns into a wildcard by its shape. URLs are then
counted by host and shape (partial sums before the shuffle, so a hot host
becomes a few rows), and a tree is grown per host, one level at a time: below
a node, a branch stays literal when its labelled block rate differs from its
siblings' by more than ``Z`` standard errors and it has ``SUPPORT`` labels, as
do shapes; all other branches merge into one wildcard. The tree is ``DEPTH`` segments deep;
what is deeper counts as one last segment ``**``. A template's smoothed purity is
``(blocked + PRIOR * base) / (labelled + PRIOR)``, base being the block rate of
all labelled URLs; it rejects its URLs at ``PURITY`` or more when at least half
of them are labelled (a template of which the rules know a corner proves
nothing about the rest).

Defined results: a null URL or one without ``://`` has empty host and path and is
allowed, as is every URL without evidence; null ids and repeated rows are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

DEPTH = 4
SUPPORT = 8
Z = 2.0
PRIOR = 10.0
PURITY = 0.9

# The rules (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPES = ((r"^[0-9]+$", "{n}"), (r"^[0-9]+(\.[A-Za-z0-9]+)$", "{n}$1"), (r"^[0-9a-fA-F]*[0-9][0-9a-fA-F-]{7,}$", "{x}"),
           (r"^.{65,}$", "{long}"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0], r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def shape_of(path: Column) -> Column:
    """Segments of a path with variable ones generalised, DEPTH at most."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")

    def shape(s: Column) -> Column:
        for pattern, to in _SHAPES:
            s = F.regexp_replace(s, pattern, to)
        return s

    head = F.transform(F.slice(parts, 1, DEPTH), shape)
    return F.when(F.size(parts) > DEPTH, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def _grow(shapes: DataFrame) -> DataFrame:
    """Adds ``template`` to rows (host, segs, n, labelled, blocked)."""
    tree = shapes.withColumn("template", F.col("host"))
    for d in range(DEPTH + 1):
        seg = F.get("segs", F.lit(d))
        edges = tree.where(seg.isNotNull()).groupBy("template", seg.alias("seg")).agg(
            F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        whole = edges.groupBy("template").agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"))
        # two-proportion test of the branch against its siblings, half a count added to each
        rest = F.col("tl") - F.col("l")
        own, other = (F.col("b") + 0.5) / (F.col("l") + 1), (F.col("tb") - F.col("b") + 0.5) / (rest + 1)
        spread = F.sqrt(own * (1 - own) / (F.col("l") + 1) + other * (1 - other) / (rest + 1))
        differs = F.abs(own - other) > Z * spread
        shaped = F.col("seg").startswith("{")
        literal = edges.where(shaped | (F.col("l") >= SUPPORT)).join(whole, "template") \
            .where(shaped | (rest == 0) | differs).select("template", "seg", F.lit(True).alias("literal"))
        tree = tree.withColumn("seg", seg).join(literal, ["template", "seg"], "left") \
            .withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(
                F.concat("template", F.lit("/"), F.when(F.col("literal"), F.col("seg")).otherwise(F.lit("*"))))) \
            .drop("seg", "literal")
        # a level reads the one before three times: cut the plan here, or it triples with every level
        tree = materialize(tree, "url-tree")
    return tree


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template), one row per row."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "known": verdict, "segs": shape_of(F.col("path"))})
    urls = urls.withColumn("shape", F.array_join("segs", "/"))
    shapes = materialize(urls.groupBy("host", "shape").agg(
        F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.count("known").alias("labelled"),
        F.count(F.when(F.col("known") == "block", 1)).alias("blocked")), "url-shapes")
    tree = _grow(shapes)
    blocked, labelled = tree.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    purity = (F.col("b") + PRIOR * (blocked / max(labelled, 1))) / (F.col("l") + PRIOR)
    judged = tree.groupBy("template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b")) \
        .withColumn("rejects", (purity >= PURITY) & (2 * F.col("l") >= F.col("n")) & (F.col("l") > 0)) \
        .select("template", "rejects")
    by_shape = tree.select("host", "shape", "template").join(judged, "template")
    return urls.join(by_shape, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("known", F.when(F.col("rejects"), "block").otherwise("allow")).alias("verdict"), "template")


def oracle(rules=RULES) -> str:
    """The same verdicts as one DuckDB statement."""
    def text(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"

    rest = "substr(url, instr(url, '://') + 3)"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}')"
    shape = "s"
    for pattern, to in _SHAPES:
        shape = f"regexp_replace({shape}, {text(pattern)}, {text(to.replace('$1', chr(92) + '1'))})"
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0], r[1] + r[2]), reverse=True)
    fits = [(f"(host = {text(h)} OR ends_with(host, {text('.' + h)})) AND starts_with(path, {text(p)})", v, h + p) for v, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN {text(r)}" for f, _, r in fits) + " END"
    known = "CASE " + " ".join(f"WHEN {f} THEN {text(v)}" for f, v, _ in fits) + " END"
    levels = []
    for d in range(DEPTH + 1):
        levels.append(f"""e{d} AS (
  SELECT template, segs[{d + 1}] AS seg, sum(l) AS l, sum(b) AS b FROM t{d} WHERE segs[{d + 1}] IS NOT NULL GROUP BY 1, 2),
r{d} AS (
  SELECT *, sum(l) OVER (PARTITION BY template) - l AS rl, sum(b) OVER (PARTITION BY template) - b AS rb FROM e{d}),
p{d} AS (
  SELECT *, (b + 0.5::DOUBLE) / (l + 1) AS own, (rb + 0.5::DOUBLE) / (rl + 1) AS other FROM r{d}),
k{d} AS (
  SELECT template, seg, starts_with(seg, '{{') OR (l >= {SUPPORT} AND (rl = 0 OR
         abs(own - other) > {Z} * sqrt(own * (1 - own) / (l + 1) + other * (1 - other) / (rl + 1)))) AS literal FROM p{d}),
t{d + 1} AS MATERIALIZED (
  SELECT t.host, t.shape, t.segs, t.n, t.l, t.b,
         CASE WHEN k.seg IS NULL THEN t.template ELSE t.template || '/' || CASE WHEN k.literal THEN k.seg ELSE '*' END END AS template
  FROM t{d} t LEFT JOIN k{d} k ON k.template = t.template AND k.seg = t.segs[{d + 1}])""")
    last = f"t{DEPTH + 1}"
    return f"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN {host} ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
u AS (
  SELECT *, {rule} AS rule, {known} AS known, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM a),
g AS (
  SELECT *, list_concat(list_transform(parts[1:{DEPTH}], lambda s: {shape}),
                        CASE WHEN len(parts) > {DEPTH} THEN ['**'] ELSE [] END) AS segs FROM u),
t0 AS MATERIALIZED (
  SELECT host, array_to_string(segs, '/') AS shape, any_value(segs) AS segs, count(*) AS n, count(known) AS l,
         count(*) FILTER (WHERE known = 'block') AS b, host AS template FROM g GROUP BY 1, 2),
{", ".join(levels)},
base AS (SELECT coalesce(sum(b), 0)::DOUBLE / greatest(coalesce(sum(l), 0), 1) AS rate FROM {last}),
j AS (
  SELECT template, l > 0 AND 2 * l >= n AND (b + {PRIOR} * rate) / (l + {PRIOR}) >= {PURITY} AS rejects
  FROM (SELECT template, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM {last} GROUP BY 1), base)
SELECT g.page_id, g.host, g.path, g.rule,
       coalesce(g.known, CASE WHEN j.rejects THEN 'block' ELSE 'allow' END) AS verdict, x.template
FROM g JOIN {last} x ON x.host = g.host AND x.shape = array_to_string(g.segs, '/') JOIN j ON j.template = x.template
"""
