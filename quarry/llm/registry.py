"""Queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import fill_middle, jaccard_join, language, licenses, lloyd, mixing, near_vectors, top_k, url_filter
from .bpe_codec import encode_decode
from .quality import quality_scores
from .token_counts import token_counts
from .token_files import read_checksums, write_token_files

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return read_checksums(index)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(_table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("row")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(_table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_middle(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_near_vectors": op2_near_vectors,
    "op3_token_files": op3_token_files,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_mixing": op10_mixing,
    "op11_centroids": op11_centroids,
    "op12_language": op12_language,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE: dict[str, str] = {
    "op1_top_k": top_k.ORACLE,
    "op2_near_vectors": near_vectors.ORACLE,
    "op4_license_scan": licenses.oracle(),
    "op8_jaccard_join": jaccard_join.LINKS_ORACLE,
    "op6_url_filter": url_filter.oracle(),
    "op10_mixing": mixing.ORACLE,
    "op11_centroids": lloyd.oracle(),
    "op13_fill_middle": fill_middle.ORACLE,
}
