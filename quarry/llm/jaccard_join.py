"""Operator 8: exact n-gram Jaccard join by PartEnum signatures.

1. Every text becomes its set of 64-bit shingle hashes; only (set hash, size,
   a sketch of parities) leave the task. Equal sets form one class, so a group of copies
   costs one member whatever its size (partial sums before the shuffle).
2. One text per class gives PartEnum signatures (see ``shingles.signatures``):
   any two sets with Jaccard >= 3/4 share one. Signatures are dealt and sorted;
   only groups of two classes or more are kept.
3. In each group all classes are compared with its smallest one; pairs that
   pass the size and the parity bound (both necessary for a link) are verified
   on whole sets. Their components join.
4. What is left are classes of one group in different components: there every
   pair is tested against the bounds inside a task, and those that pass are
   verified too. A group of more than ``BLOCK`` classes is cut into blocks, and
   every pair of blocks is a task's work, so no group meets in one task.
   Links inside a component need no test here: they cannot change the components.
5. ``jaccard_links`` also counts the links of every document. All links lie
   inside components, so there every pair of classes is met once, in blocks of
   ``LINK_ROWS`` classes dealt in pairs (small components share a block), and
   its whole sets are intersected; a class and a partial count leave the task.

The bounds and the verification are exact up to equal 64-bit hashes of
different shingles (about 1e-14 for a pair of texts of 500 words).

Defined results: null and empty text has no shingles and links with nothing
(component: its own id); fewer words than ``width`` form one shingle; null ids
stay, and a component of null ids alone is null; rows of equal id are rows of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import shingles as S
from .components import components
from .slices import binary_slices, slim

WIDTH = 5
BLOCK = 4096
CHUNK_ROWS = 16_384      # rows of groups compared at once
UNIT_ROWS = 1_000_000   # rows of one unit of work
UNIT_PAIRS = 200_000    # pairs held back by a task for repeats
LINK_ROWS = 1024         # classes of one block when links are counted
LINK_ITEMS = 500_000     # and shingles, about


def _sets(width: int):
    """(doc_id, text, h) to (doc_id, h, n_shingles, c, c2, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in binary_slices(b.column("text")):
                flat, sizes = S.shingle_sets(texts, width)
                c, c2 = S.set_hashes(flat, sizes)
                sketch = S.parity_sketches(flat, sizes)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, len(texts)), b.column("h").slice(lo, len(texts)), pa.array(sizes, pa.int64()),
                     pa.array(c.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(sketch, pa.binary())],
                    ["doc_id", "h", "n_shingles", "c", "c2", "sketch"])
    return run


def _fresh(seen: set, c: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the sets this task has met: rows of one key may be copies."""
    new = np.fromiter((not (k in seen or seen.add(k)) for k in c.tolist()), bool, len(c))
    return (c, flat, sizes) if new.all() else (c[new], flat[np.repeat(new, sizes)], sizes[new])


def _signatures(width: int):
    """text to (sig, c)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            for _, texts in binary_slices(b.column("text")):
                flat, sizes = S.shingle_sets(texts, width)
                c, flat, sizes = _fresh(seen, S.set_hashes(flat, sizes)[0], flat, sizes)
                sig, own = S.signatures(flat, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(c[own].view(np.int64))],
                                                 ["sig", "c"])
    return run


def _whole_sets(width: int):
    """text to (c, items): the set itself, sorted, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            for _, texts in binary_slices(b.column("text")):
                flat, sizes = S.shingle_sets(texts, width)
                c, flat, sizes = _fresh(seen, S.set_hashes(flat, sizes)[0], flat, sizes)
                at = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.view(np.int64)),
                     pa.array([flat[at[i]:at[i + 1]].tobytes() for i in range(len(sizes))], pa.binary())], ["c", "items"])
    return run


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, c) sorted by both, to those whose sig has another c, with
    the sig's smallest c as ``hub``. One row is held over a batch's end."""
    held_sig = held_c = None      # last row seen
    hub, given = None, False      # of the open group: smallest c, and whether it was given out
    for b in batches:
        sig, c = b.column("sig").to_numpy(), b.column("c").to_numpy()
        if not len(sig):
            continue
        if held_sig is not None:
            sig, c = np.concatenate([[held_sig], sig]), np.concatenate([[held_c], c])
            keep = np.ones(len(sig), bool)
            keep[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])
            carried = 1
        else:
            keep = np.ones(len(sig), bool)
            keep[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])
            carried = 0
        sig, c = sig[keep], c[keep]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        group = np.cumsum(first) - 1
        hubs = c[first]
        if carried:
            hubs = hubs.copy()
            hubs[0] = hub
        size = np.bincount(group)
        out = size[group] > 1
        if carried:
            # the carried row was given out already if its group was known to be shared
            was = given
            out = out | ((group == 0) & was)
            out[0] = out[0] and not was
        held_sig, held_c = sig[-1], c[-1]
        hub = hubs[-1]
        given = bool(out[-1]) or (len(sig) == 1 and bool(carried) and given)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(c[out]), pa.array(hubs[group[out]])],
                                             ["sig", "c", "hub"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that size and parity allow to link: 7 * difference <= sum."""
    for b in batches:
        sketches = S.Sketches(b.column("sketch_a").to_pylist() + b.column("sketch_b").to_pylist())
        n_a, n_b = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
        ok = np.flatnonzero(7 * np.abs(n_a - n_b) <= n_a + n_b)
        ok = ok[7 * sketches.differ(ok, ok + b.num_rows) <= (n_a + n_b)[ok]]
        ok = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column("a").take(ok), b.column("b").take(ok)], ["a", "b"])


def _pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of one group, of different labels (and sides, across blocks), that
    pass the bounds. Rows are sorted by group and size, so row i meets i + 1,
    i + 2, ... until the group ends or sizes differ too much."""
    key = np.stack([t.column(k).to_numpy() for k in ("sig", "x", "y")])
    n, c, label, side = (t.column(k).to_numpy() for k in ("n", "c", "label", "side"))
    across = key[1] != key[2]
    group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
    sketches = S.Sketches(t.column("sketch").to_pylist())
    i, step = np.arange(len(n)), 0
    while len(i):
        step += 1
        i = i[i + step < len(n)]
        j = i + step
        i = i[(group[i] == group[j]) & (7 * (n[j] - n[i]) <= n[i] + n[j])]
        j = i + step
        wanted = (label[i] != label[j]) & (~across[i] | (side[i] != side[j]))
        a, b = i[wanted], j[wanted]
        ok = 7 * sketches.differ(a, b) <= n[a] + n[b]
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[a[ok]]), pa.array(c[b[ok]])], ["a", "b"])


def _distinct(pairs: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([p.column(i).to_numpy() for p in pairs]) for i in (0, 1))
    a, b = np.maximum(a, b), np.minimum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])


def _within_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (low, part, sig, x, y, side, c, label, n, sketch), sorted by the
    first five and n, to their pairs. Groups (of two blocks at most) are worked
    on some at a time; near texts meet in many groups, so up to UNIT_PAIRS pairs are
    held back and given once (the caller makes the rest distinct)."""
    rows, size, found, last = [], 0, [], None

    def work() -> None:
        nonlocal rows, size
        if size:
            found.extend(_pairs_of(pa.Table.from_batches(rows)))
            if len(found) > 1:
                found[:] = [_distinct(found)]
        rows, size = [], 0

    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(k).to_numpy() for k in ("low", "part", "sig", "x", "y")])
        starts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if last is not None and (key[:, 0] != last).any():
            starts = np.concatenate([[0], starts])
        lo = 0
        while (at := int(np.searchsorted(starts, lo + CHUNK_ROWS - size))) < len(starts):
            s = int(starts[at])
            rows.append(b.slice(lo, s - lo))
            size += s - lo
            work()
            if found and found[0].num_rows > UNIT_PAIRS:
                yield found.pop()
            lo = s
        rows.append(b.slice(lo))
        size += b.num_rows - lo
        last = key[:, -1]
    work()
    yield from found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, items_a, items_b) to the linked (a, b)."""
    for b in batches:
        ok = []
        for x, y in zip(b.column("items_a"), b.column("items_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= 75 * (len(x) + len(y) - both))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])


def _shared(a: np.ndarray, own_a: np.ndarray, n_a: int, b: np.ndarray, own_b: np.ndarray, n_b: int) -> np.ndarray:
    """Shingles that set i of one side and set j of the other have in common.
    Those in many sets of both are multiplied as 0/1 columns, the others
    paired row by row."""
    items, col_b, f_b = np.unique(b, return_inverse=True, return_counts=True)
    at = np.minimum(np.searchsorted(items, a), len(items) - 1)
    met = items[at] == a
    col_a, own_a = at[met], own_a[met]
    f_a = np.bincount(col_a, minlength=len(items))
    out = np.zeros((n_a, n_b), np.int64)
    dense = f_a * f_b > max(64, n_a * n_b // 32)
    wide = np.flatnonzero(dense)
    place = np.cumsum(dense) - 1
    in_a, in_b = dense[col_a], dense[col_b]
    da, ra, db, rb = place[col_a[in_a]], own_a[in_a], place[col_b[in_b]], own_b[in_b]
    for lo in range(0, len(wide), 1024):
        x, y = np.zeros((n_a, 1024), np.float32), np.zeros((n_b, 1024), np.float32)
        here, there = (da >= lo) & (da < lo + 1024), (db >= lo) & (db < lo + 1024)
        x[ra[here], da[here] - lo] = 1
        y[rb[there], db[there] - lo] = 1
        out += (x @ y.T).astype(np.int64)
    col_a, own_a = col_a[~in_a], own_a[~in_a]
    order = np.argsort(col_b, kind="stable")
    rows_b, first_b = own_b[order], np.cumsum(f_b) - f_b
    ends = np.cumsum(f_b[col_a])
    lo = 0
    while lo < len(col_a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000)))
        times = f_b[col_a[lo:hi]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        j = rows_b[np.repeat(first_b[col_a[lo:hi]], times) + step]
        out += np.bincount(np.repeat(own_a[lo:hi], times) * n_b + j, minlength=n_a * n_b).reshape(n_a, n_b)
        lo = hi
    return out


def _count_links(t: pa.Table) -> pa.Table:
    """Rows (x, y, side, c, copies, items) of a block (x = y) or of two to
    (c, n): the documents of other classes here that each class links with."""
    c, side = t.column("c").to_numpy(), t.column("side").to_numpy()
    copies, blob = t.column("copies").to_numpy(), t.column("items").to_pylist()
    one = t.column("x")[0] == t.column("y")[0]

    def sets(rows: np.ndarray):
        own = [np.frombuffer(blob[r], np.uint64) for r in rows]
        size = np.fromiter(map(len, own), np.int64, len(own))
        return (np.concatenate(own) if own else np.zeros(0, np.uint64)), np.repeat(np.arange(len(own)), size), size

    left = np.arange(len(c)) if one else np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return pa.table({"c": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    (a, own_a, n_a), (b, own_b, n_b) = sets(left), sets(right)
    both = _shared(a, own_a, len(left), b, own_b, len(right))
    linked = 100 * both >= 75 * (n_a[:, None] + n_b[None, :] - both)
    if one:
        np.fill_diagonal(linked, False)
        found = [(c[left], linked @ copies[right])]
    else:
        found = [(c[left], linked @ copies[right]), (c[right], copies[left] @ linked)]
    return pa.table({"c": np.concatenate([k for k, _ in found]), "n": np.concatenate([n for _, n in found]).astype(np.int64)})


def _partners(named: DataFrame, sets: DataFrame, rows: int, items: int) -> DataFrame:
    """(c, n) for the classes of ``named`` in components of several: documents of
    other classes they link with, from the whole ``sets`` (c, items)."""
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("total")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / rows), F.ceil(F.col("total") / items)).cast("long")
    sizes = materialize(sizes.select("root", F.least("size", blocks).alias("k"), "size", "total"), "component-sizes")
    small = sizes.where("k = 1").agg(F.sum("size"), F.sum("total")).first()
    parts = max(1, -(-(small[0] or 0) // rows), -(-(small[1] or 0) // items))
    # components of one block share blocks: sets of different components do not link
    alone = F.col("k") == 1
    members = named.join(sizes, "root").withColumns({
        "unit": F.when(alone, F.pmod(F.xxhash64("root"), F.lit(parts)) - parts).otherwise(F.lit(0).cast("long")),
        "root": F.when(alone, F.lit(0).cast("long")).otherwise(F.col("root"))})
    dealt = members.withColumn("own", F.pmod(F.xxhash64("c"), F.col("k"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))) \
        .join(sets, "c").select(
            "root", "unit", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "c", "copies", "items")
    return dealt.groupBy("root", "unit", "x", "y").applyInArrow(_count_links, "c long, n long") \
        .groupBy("c").agg(F.sum("n").alias("n"))


def _key() -> Column:
    """Of a row, never null: its id; of a null id the hash ``h`` of its text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("h"))


def _links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes whose sets link, and the sets (c, items) of
    all pairs, as written tables."""
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct() \
        .join(classes.select("c", "key"), "c").select("key").distinct()
    sets = texts.withColumn("key", _key()).join(ids, "key", "left_semi").select("text").mapInArrow(slim(_whole_sets(width)), "c long, items binary")
    sets = materialize(sets.dropDuplicates(["c"]), "sets")
    left = sets.select(F.col("c").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("c").alias("b"), F.col("items").alias("items_b"))
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")
                       .mapInArrow(slim(_verify), "a long, b long"), "linked"), sets


def _bounded_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that pass the bounds."""
    side = lambda k: classes.select(F.col("c").alias(k), F.col("n_shingles").alias(f"n_{k}"),
                                    F.col("sketch").alias(f"sketch_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(slim(_bounded), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    return _join(docs, id_col, text_col, width, block)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                  block: int = BLOCK, rows: int = LINK_ROWS, items: int = LINK_ITEMS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row per row of
    ``docs``; n_links: other rows it links with, copies of its set included."""
    return _join(docs, id_col, text_col, width, block, (rows, items))


def _join(docs: DataFrame, id_col: str, text_col: str, width: int, block: int,
          counted: tuple[int, int] | None = None) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(F.when(F.col(id_col).isNull(), F.col(text_col))).alias("h"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = materialize(texts.mapInArrow(
        slim(_sets(width)), f"doc_id {id_type}, h long, n_shingles long, c long, c2 long, sketch binary"), "shingle-sets", compact=True)
    classes = rows.where("n_shingles > 0").groupBy("c", "c2", "n_shingles") \
        .agg(F.min("doc_id").alias("doc_id"), F.min(_key()).alias("key"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")

    # one text per class: leave out rows whose key is nobody's smallest
    copies = rows.select(_key().alias("key")).join(classes.select("key"), "key", "left_anti").distinct()
    copies = materialize(copies, "copies")
    shared = texts.where(F.length("text") > 0).withColumn("key", _key()).join(copies, "key", "left_anti").select("text") \
        .mapInArrow(slim(_signatures(width)), "sig long, c long") \
        .repartition("sig").sortWithinPartitions("sig", "c").mapInArrow(slim(_shared_only), "sig long, c long, hub long")
    shared = materialize(shared, "shared-signatures")

    hubs = shared.where("c != hub").select(F.col("c").alias("a"), F.col("hub").alias("b")).distinct()
    tested = _bounded_pairs(hubs, classes)
    links, sets = _links(tested, texts, classes, width)
    found = components(links)

    labelled = shared.select("sig", "c").join(found, F.col("c") == F.col("node"), "left") \
        .select("sig", "c", F.coalesce("root", "c").alias("label"))
    groups = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                         F.count(F.lit(1)).alias("size")).where("low != high")
    # groups of one family share their lowest label: dealt together, in parts of bounded size
    families = groups.groupBy("low").agg(F.ceil(F.sum("size") / UNIT_ROWS).cast("long").alias("parts"))
    members = labelled.join(groups.join(families, "low"), "sig") \
        .withColumns({"k": F.ceil(F.col("size") / block).cast("long"), "part": F.pmod(F.xxhash64("sig"), F.col("parts"))}) \
        .withColumn("own", F.pmod(F.xxhash64("c"), F.col("k"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))) \
        .join(classes.select("c", F.col("n_shingles").alias("n"), "sketch"), "c") \
        .select("low", "part", "sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "c", "label", "n", "sketch")
    more = members.repartition("low", "part", "x", "y") \
        .sortWithinPartitions("low", "part", "sig", "x", "y", "n").mapInArrow(slim(_within_blocks), "a long, b long") \
        .distinct().join(hubs, ["a", "b"], "left_anti")
    late, late_sets = _links(more, texts, classes, width)
    found = components(links.union(late))

    named = classes.join(found, F.col("c") == F.col("node"), "left") \
        .select("c", "c2", F.col("n_shingles"), "doc_id", "copies", F.coalesce("root", "c").alias("root"))
    low = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    per_class = ["component_id"]
    if counted:
        named = materialize(named, "named")
        sets = sets.union(late_sets.join(sets.select("c"), "c", "left_anti"))
        named = named.join(_partners(named, sets, *counted), "c", "left") \
            .withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
        per_class.append("n_links")
    named = named.join(low, "root").select("c", "c2", "n_shingles", *per_class)
    out = rows.join(named, ["c", "c2", "n_shingles"], "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    if counted:
        out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return out.select("doc_id", "n_shingles", *per_class)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
      FROM w, unnest(range(1, 1 + CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - 4) END)) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
      WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.seen)::BIGINT AS component_id
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
"""

#: With the number of links, as another statement.
LINKS_ORACLE = ORACLE.replace("min(r.seen)::BIGINT AS component_id", """min(r.seen)::BIGINT AS component_id,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id)::BIGINT AS n_links""")
