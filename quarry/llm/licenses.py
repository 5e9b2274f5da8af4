"""Operator 4 [native]: license scans by an exact set-similarity join.

Base: the places where a phrase's words stand consecutively.

Method: a text is cut into blocks of ``BLOCK`` words (or twice those of the
longest template, if more) that overlap by half, so
every passage of up to half a block lies whole in one. A block matches a
template when it holds at least ``alpha = ceil(threshold * |T|)`` of its |T|
distinct tokens. Tokens are ordered by the number of documents that hold them,
counted over the whole corpus, rarest first. A matching block must hold one of
the template's first ``|T| - alpha + 1`` tokens (prefix filter), at least alpha
template tokens at all (length filter), and at a shared prefix token enough
tokens must be left on both sides (positional filter). Pairs that pass are
verified by their intersection, so the join is exact.

Only blocks that hold a prefix token leave their row. The templates are a
fixed list, so their index (a row per prefix token) is broadcast by a proven
bound.

Defined results: null or empty text has no words, places or labels and score 0;
null ids and repeated rows are kept; an empty table gives no rows; other
columns are ignored. Score: 1 with a base place, else the best containment of a
matched template, else 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 64
THRESHOLD = 0.8

# Phrases of the base and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening sentences of public license texts and notices.
TEMPLATES = {
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in"
                " compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided"
           " that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl": "this work is licensed under the gnu general public license version",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                  " general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
           " associated documentation files the software to deal in the software without restriction",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "proprietary": "all rights reserved no part of this publication may be reproduced distributed or transmitted in"
                   " any form without the prior written permission of the publisher",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP)
    return F.filter(parts, lambda w: w != "")


def places(words: Column, phrase: str) -> Column:
    """Start positions of ``phrase`` in an array of words."""
    ws = phrase.split(" ")
    held = F.lit(True)
    for w in ws:
        held &= F.array_contains(words, w)
    none = F.array().cast("array<int>")

    def here(i: Column) -> Column:
        match = F.get(words, i) == ws[0]
        for j, w in enumerate(ws[1:], 1):
            match &= F.get(words, i + j) == w
        return match

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(ws)), here)
    return F.when(held & (F.size(words) >= len(ws)), starts).otherwise(none)


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
                 templates: dict[str, str] | None = None, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score), one row per row of ``docs``."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    spark = docs.sparkSession
    tokens = {name: list(dict.fromkeys(t.split(" "))) for name, t in templates.items()}
    # half a block holds the longest template, so some block holds any copy of it whole
    block = max(block, 2 * max(len(t.split(" ")) for t in templates.values()))
    vocabulary = sorted({t for ts in tokens.values() for t in ts})
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))

    # documents per token, over the whole corpus: as many rows as the templates have tokens
    counted = {r["token"]: r["n"] for r in
               rows.select(F.explode(F.array_intersect("words", _lit_array(vocabulary))).alias("token"))
               .groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counted.get(t, 0), t)))}
    index = []
    for name, ts in tokens.items():
        ranks = sorted(rank[t] for t in ts)
        alpha = math.ceil(threshold * len(ts) - 1e-9)
        index += [(name, ranks, alpha, r, i) for i, r in enumerate(ranks[:len(ts) - alpha + 1])]
    prefix = sorted({r for _, _, _, r, _ in index})
    by_rank = sorted(rank, key=rank.get)
    least = min(a for _, _, a, _, _ in index)

    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - block) / (block // 2))).cast("int"))
    blocks = F.transform(starts, lambda k: F.array_intersect(
        F.slice("words", k * (block // 2) + 1, block), _lit_array(vocabulary)))
    rare = _lit_array([by_rank[r] for r in prefix])
    blocks = F.filter(blocks, lambda b: (F.size(b) >= least) & F.arrays_overlap(b, rare))
    base = [places(F.col("words"), p) for p in phrases]
    found = rows.select("doc_id", n.cast("long").alias("n_words"), *[b.alias(f"p{i}") for i, b in enumerate(base)],
                        F.when(F.arrays_overlap("words", rare), blocks).alias("blocks"))
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "license-blocks")

    to_rank = F.create_map(*[x for t, r in rank.items() for x in (F.lit(t), F.lit(r))])
    cut = found.select("row", F.posexplode("blocks").alias("block", "held")) \
        .select("row", "block", F.array_sort(F.transform("held", lambda t: F.element_at(to_rank, t))).alias("held"))
    lists = spark.createDataFrame(index, "template string, ranks array<int>, alpha int, token int, t_at int")
    pairs = cut.select("row", "block", "held", F.posexplode("held").alias("b_at", "token")) \
        .join(F.broadcast(lists), "token") \
        .where((F.size("held") >= F.col("alpha")) & (
            1 + F.least(F.size("ranks") - 1 - F.col("t_at"), F.size("held") - 1 - F.col("b_at")) >= F.col("alpha")))
    shared = F.size(F.array_intersect("held", "ranks"))
    hits = pairs.where(shared >= F.col("alpha")).groupBy("row").agg(
        F.collect_set("template").alias("matched"), F.max(shared / F.size("ranks")).alias("best"))

    all_places = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    names = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]),
                     lambda x: x.isNotNull())
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    n_base = F.size(all_places)
    return found.join(hits, "row", "left").select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
        joined(names).alias("base_labels"),
        joined(F.concat(names, F.coalesce("matched", F.array().cast("array<string>")))).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def oracle() -> str:
    """DuckDB SQL by brute force: every block against every template."""
    temps = ", ".join(f"('{k}', list_distinct(string_split('{v}', ' ')))" for k, v in TEMPLATES.items())
    base = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM w, unnest(range(1, len(ws) + 1)) AS u(i) WHERE "
        + " AND ".join(f"ws[i + {j}] = '{x}'" for j, x in enumerate(p.split(" "))) for p, label in PHRASES.items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS ({base}),
bb AS (SELECT doc_id, count(*) AS n, min(pos) AS f, max(pos) AS l FROM b GROUP BY doc_id),
t(name, ts) AS (VALUES {temps}),
k AS (SELECT doc_id, list_distinct(ws[i * {BLOCK // 2} + 1 : i * {BLOCK // 2} + {BLOCK}]) AS held
      FROM w, unnest(range(0, 1 + greatest(0, ceil((len(ws) - {BLOCK}) / {BLOCK / 2}))::BIGINT)) AS u(i)),
m AS (SELECT doc_id, name, len(list_intersect(held, ts)) / len(ts) AS share FROM k, t
      WHERE len(list_intersect(held, ts)) >= ceil({THRESHOLD} * len(ts) - 1e-9)),
mm AS (SELECT doc_id, max(share) AS best FROM m GROUP BY doc_id),
lb AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT DISTINCT doc_id, label FROM b) GROUP BY doc_id),
la AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS x
       FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, name FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(bb.n, 0)::BIGINT AS n_base, bb.f::BIGINT AS first_word,
       bb.l::BIGINT AS last_word, coalesce(lb.x, '') AS base_labels, coalesce(la.x, '') AS labels,
       (CASE WHEN bb.n > 0 THEN 1.0 ELSE coalesce(mm.best, 0.0) END)::DOUBLE AS score
FROM w LEFT JOIN bb USING (doc_id) LEFT JOIN mm USING (doc_id) LEFT JOIN lb USING (doc_id) LEFT JOIN la USING (doc_id)
"""
