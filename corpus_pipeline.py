"""The corpus pipeline over ``documents``: quality classifier, n-gram Jaccard
join, mixing sources to target weights, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of ``documents``:

* ``quality``: documents the factorisation machine rejects go. It learns from
  ``labels`` as operator 5 does.
* ``near-duplicates``: of every component of linked documents the one with the
  smallest id stays (null is the smallest); documents without words link with
  nothing and stay. Rows are told apart by id and text: a row repeated in both
  stays once, and rows of one id with texts that do not link all stay.
* ``mix``: a document comes as many times as the mix takes its words, rounded
  (0 to 3 copies; the one document cut by the budget is kept or dropped whole).
  Every row has its own number of copies, null and repeated ids too; the seeded
  order is that of a hash of id and text.
* ``bpe``: (doc_id, n_tokens, ids, decoded_sha256), ids as
  little-endian unsigned 32-bit integers.

Empty tables and null ids, texts and sources pass as the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.llm.bpe_codec import encode_decode
from quarry.llm.jaccard_join import jaccard_components
from quarry.llm.mixing import mix
from quarry.llm.quality import accepted
from quarry.session import materialize, ship_package

TOKENIZER = "byte_bpe_50k.json"


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    key = _unused(docs, "key_")
    keyed = docs.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    found = jaccard_components(keyed, id_col=key).where("n_shingles > 0")
    links = materialize(found.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n")), "classes")
    gone = links.where("doc_id != component_id").select(F.col("doc_id").alias(key))
    again = links.where("doc_id = component_id and n > 1").select(F.col("doc_id").alias(key))
    left = keyed.join(gone.union(again), key, "left_anti")
    once = keyed.join(again, key, "left_semi").dropDuplicates([key])
    return left.union(once).select(docs.columns)


def _with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a unique key of each row that does not change when they are read
    again: its place in its file; docs that come from no file are written first."""
    def placed(rows: DataFrame) -> DataFrame:
        at = rows.metadataColumn("_metadata")
        return rows.withColumn(name, F.struct(at["file_path"], at["row_index"]))

    try:
        return placed(docs)
    except AnalysisException:
        return placed(materialize(docs, "mix-rows"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, copies = _unused(docs, "row_"), _unused(docs, "copies_")
    rows = _with_row_key(docs, row)
    taken = mix(rows, row_col=row).where("size > 0").select(
        F.col("row").alias(row), F.round(F.col("taken") / F.col("size")).cast("int").alias(copies))
    return rows.join(taken.where(F.col(copies) > 0), row) \
        .withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return encode_decode(docs, public_tokenizers.path(TOKENIZER)).select(
        "doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near-duplicates", near_duplicates), ("mix", mixed), ("bpe", bpe)]

#: A learned model decides the first stage; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
