"""Operator 12: language identification by sparse multinomial logistic regression.

Features: a text's letters, lower-cased, with a mark between words, give character
n-grams of 1 to ``NGRAMS`` letters and marks (marks at the ends only), hashed into
``BUCKETS``. Values are (1 + log count) * idf, scaled to length 1; idf counts every
document of the learning fold, as one partial vector a task.

Learning: follow-the-regularised-leader (proximal, per coordinate) on the softmax
loss with elastic-net penalties, so most weights are exactly zero. It takes a
bounded sample: about ``SAMPLE_ROWS`` different rows, the same number for every
language that has as many, chosen by a hash of the whole row from those whose
crc32(id) mod 4 is not 2, whatever the size of the corpus; equal rows are met
once, in every task and again in the shuffle. A tenth of the sample is kept out of
the fit and sets one temperature that divides all logits (least log loss).
Prediction runs over every text in parallel with the model in the task.
Language, source and id are no inputs of a prediction.

Defined results: a text that is null or has no letter (Unicode categories L) is
``und`` with score 0, and so is every text when nothing can be learned; one learned
language is predicted for all others with score 1; null ids are kept, count as the
empty string for the fold and never train; equal logits go to the smaller name;
repeated rows give equal rows; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix
from .slices import binary_slices, slim

NGRAMS = 3
BITS = 16
BUCKETS = 1 << BITS
SAMPLE_ROWS = 8_000
UNKNOWN = "und"
EPOCHS, BATCH = 4, 32
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
HELD_FOLD = 2


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, counts, entries per text) of the n-grams of ``texts``."""
    n = len(texts)
    words = [t.decode("utf-8", "replace").lower() for t in texts]
    size = np.fromiter((len(w) + 1 for w in words), np.int64, n)
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]       # the first non-letter after a letter is the mark
    keep[0] = True
    doc = np.concatenate([[0], np.repeat(np.arange(n), size)])[keep].astype(np.uint32)
    code = np.where(letter, codes, 0)[keep].astype(np.uint64)
    found, run = [], code
    for k in range(1, NGRAMS + 1):
        if len(code) < k:
            break
        if k > 1:
            run = mix(run[:-1] * np.uint64(0x100000001B3) + code[k - 1:])
        # a single letter, or marks at the ends only
        fits = np.ones(len(run), bool) if k > 1 else code > 0
        for j in range(1, k - 1):
            fits &= code[j:len(code) - k + 1 + j] > 0
        at = np.flatnonzero(fits)
        bucket = mix(run[at] + np.uint64(k)) >> np.uint64(64 - BITS)
        found.append((doc[at + k - 1].astype(np.uint64) << np.uint64(BITS)) | bucket)
    keys = np.concatenate(found)
    if n < 1 << (32 - BITS):
        keys = keys.astype(np.uint32)      # sorts faster
    keys, counts = np.unique(keys, return_counts=True)
    return (keys & (BUCKETS - 1)).astype(np.int64), counts, np.bincount((keys >> BITS).astype(np.int64), minlength=n)


def weighted(bucket: np.ndarray, counts: np.ndarray, per: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf values, every text's of length 1."""
    v = (1 + np.log(counts)) * idf[bucket]
    row = np.repeat(np.arange(len(per)), per)
    length = np.sqrt(np.bincount(row, v * v, len(per)))
    return v / np.maximum(length, 1e-12)[row]


@dataclass
class Model:
    """Weights (buckets and the bias by languages), idf and temperature."""

    langs: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, bucket: np.ndarray, value: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Of texts that have entries."""
        start = np.cumsum(per) - per
        return np.add.reduceat(self.weights[bucket] * value[:, None], start, axis=0) + self.weights[-1]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        bucket, counts, per = grams(texts)
        full = np.flatnonzero(per)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(full) and self.langs:
            p = softmax(self.logits(bucket, weighted(bucket, counts, per, self.idf), per[full]) / self.temperature)
            best = p.argmax(axis=1)
            score[full] = p[np.arange(len(full)), best]
            for i, b in zip(full.tolist(), best.tolist()):
                names[i] = self.langs[b]
        return names, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader for a softmax over hashed features."""

    def __init__(self, features: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        """The minimiser of the regularised sum so far; zero where |z| <= l1. The bias is not penalised."""
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)[:, None]
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, bucket: np.ndarray, value: np.ndarray, per: np.ndarray, y: np.ndarray) -> None:
        bias = len(self.z) - 1
        at, where = np.unique(bucket, return_inverse=True)
        at = np.append(at, bias)
        w = self.weights(at)
        start = np.cumsum(per) - per
        p = softmax(np.add.reduceat(w[where] * value[:, None], start, axis=0) + w[-1])
        p[np.arange(len(y)), y] -= 1
        rows = np.repeat(np.arange(len(y)), per)
        g = np.stack([np.bincount(where, p[rows, c] * value, len(at)) for c in range(p.shape[1])], axis=1)
        g[-1] = p.sum(axis=0)
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm. Targets
    are smoothed by one row of each side, so that rows without an error do not
    make every score 1."""
    sure = (len(y) + 1) / (len(y) + 2)

    def loss(log_t: float) -> float:
        p = np.maximum(softmax(logits / np.exp(log_t)), 1e-300)
        right = np.log(p[np.arange(len(y)), y])
        others = (np.log(p).sum(axis=1) - right) / (p.shape[1] - 1)
        return float(-(sure * right + (1 - sure) * others).mean())

    lo, hi, r = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(rows: list[tuple[int, str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH) -> Model:
    """From rows (hash, language, buckets, counts)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    langs = sorted({r[1] for r in rows})
    if len(langs) < 2:
        return Model(langs, np.zeros((BUCKETS + 1, len(langs)), np.float32), idf)
    per = np.array([len(r[2]) for r in rows])
    bucket, counts = np.concatenate([r[2] for r in rows]).astype(np.int64), np.concatenate([r[3] for r in rows])
    value = weighted(bucket, counts, per, idf)
    y = np.array([langs.index(r[1]) for r in rows])
    start = np.cumsum(per) - per

    def of(some: np.ndarray):
        at = np.repeat(start[some] - (np.cumsum(per[some]) - per[some]), per[some]) + np.arange(per[some].sum())
        return bucket[at], value[at], per[some], y[some]

    held = mix(np.array([r[0] for r in rows], np.int64).view(np.uint64)) % np.uint64(10) == 0
    learn = np.flatnonzero(~held)
    leader, rng = Leader(BUCKETS, len(langs)), np.random.default_rng(5)
    for _ in range(max(epochs, -(-4_000 // max(1, len(learn))))):
        for some in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)):
            if len(some):
                leader.step(*of(some))
    model = Model(langs, leader.weights(np.arange(BUCKETS + 1)).astype(np.float32), idf.astype(np.float32))
    if held.any():
        b, v, p, want = of(np.flatnonzero(held))
        model.temperature = calibrated(model.logits(b, v, p).astype(float), want)
    return model


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the task's (bucket, texts it is in); bucket -1: all texts with letters."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for _, texts in binary_slices(b.column("text")):
            bucket, _, per = grams(texts)
            df += np.bincount(bucket, minlength=BUCKETS)
            n += int(np.count_nonzero(per))
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(df[seen], n))], ["bucket", "n"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, lang, text) to (h, lang, buckets, counts), each h once a task."""
    seen: set = set()
    for b in batches:
        new = [not (h in seen or seen.add(h)) for h in b.column("h").to_pylist()]
        b = b.filter(pa.array(new, pa.bool_()))
        for lo, texts in binary_slices(b.column("text")):
            bucket, counts, per = grams(texts)
            part, end = b.slice(lo, len(texts)), np.cumsum(per)
            cut = lambda x: pa.array([x[e - k:e].tobytes() for e, k in zip(end, per)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("lang"), cut(bucket.astype("<u2")),
                                              cut(counts.astype("<f4"))], ["h", "lang", "buckets", "counts"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the learning fold of ``docs``."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("id")) != HELD_FOLD))
    # one row per language
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.ones(BUCKETS, np.float32))
    found = known.select("text").mapInArrow(slim(_frequencies), "bucket int, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS), 1
    for r in found:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    quota = max(1, sample_rows // len(sizes))
    hashed = known.withColumn("h", F.xxhash64("id", "text", "lang"))
    share = F.pmod("h", F.lit(1_000_003))
    wanted = F.lit(False)
    for lang, count in sorted(sizes.items()):
        wanted = wanted | ((F.col("lang") == lang) & (share < (1_000_003 if count <= quota else int(1_000_003 * quota / count))))
    rows = hashed.where(wanted).select("h", "lang", "text") \
        .mapInArrow(slim(_entries), "h long, lang string, buckets binary, counts binary") \
        .groupBy("h", "lang").agg(F.first("buckets").alias("buckets"), F.first("counts").alias("counts")).collect()
    return fit([(r["h"], r["lang"], np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<f4")) for r in rows], idf)


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in binary_slices(b.column("text")):
                names, score = model.predict(texts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, len(texts)), pa.array(names, pa.string()),
                                                  pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
    return run


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(slim(_predicted(model)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``."""
    found = predicted(docs, train(docs, id_col, text_col, lang_col, sample_rows), id_col, text_col)
    return found.select("doc_id", (fold(F.col("doc_id")) == HELD_FOLD).alias("held_out"), "lang_pred", "score")
