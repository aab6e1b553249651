"""Tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; Catalyst prunes its columns and pushes filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
