"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm.pii import find_personal_data, redact
from textquarry.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of personal data in the audit rows."""
    return find_personal_data(table(spark, sf, "audit_row"), "audit_id", "text").select("audit_id", "pii_kind", "ordinal")


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The audit rows with typed placeholders for personal data."""
    return redact(table(spark, sf, "audit_row"), "audit_id", "text")


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
