"""Named Parquet tables under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name``: a Parquet file or a directory of them."""
    return spark.read.parquet(f"{root}/{name}.parquet")
