"""Queries of the corpus-qualification operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict:
    """Every query of the core: (spark, directory of tables) -> DataFrame."""
    from textquarry.plans.catalog import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    from textquarry.plans.sql import SQL

    return dict(SQL)


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Manifest over all candidates: validation, screening order, exact and near deduplication, categories, tokens."""
    from textquarry.plans.catalog import global_manifest

    return global_manifest(spark, root)
