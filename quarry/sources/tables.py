"""Readers for the input tables (S1, S2, S5, S6 live in sibling modules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; Catalyst prunes columns and pushes
    filters into the scan."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
