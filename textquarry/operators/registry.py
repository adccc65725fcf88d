"""Registries and fail-closed checks: every rule yields rows (rule, id, detail) of what breaks it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.keys import strip
from textquarry.functions.text import content_sha256, dedup_fingerprint, from_hex, sha256_valid, simhash64

# The enumerations of records and registries.
PARTITIONS = ("train", "validation", "holdout")
LANES = ("release_safe", "research_only", "blocked")
LANGUAGES = ("th", "en", "mixed")
CATEGORIES = ("general_thai", "general_english", "technical_scientific_code", "flywire_domain")
STATUSES = ("accept", "exclude", "quarantine", "reject")
#: Lanes that a checkpoint of a lane may draw on.
VISIBLE = {"release_safe": ("release_safe",), "research_only": ("release_safe", "research_only")}


class ContractError(ValueError):
    """Rows break a contract."""


def violation(df: DataFrame, rule: str, id_col: Column | str, broken: Column, detail: Column | None = None) -> DataFrame:
    """Rows of ``df`` for which ``broken`` holds; a null condition counts as broken."""
    name = F.col(id_col) if isinstance(id_col, str) else id_col
    return df.where(F.coalesce(broken, F.lit(True))).select(F.lit(rule).alias("rule"), name.cast("string").alias("id"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit("null"))).alias("detail"))


def all_violations(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def require(frame: DataFrame, what: str, shown: int = 5) -> None:
    """Raise ContractError if there is any violation."""
    rows = frame.limit(shown).collect()
    if rows:
        raise ContractError(f"{what}: " + "; ".join(f"{r['rule']} {r['id']} {r['detail']}".strip() for r in rows))


def required(df: DataFrame, id_col: str, columns: Iterable[str], blank_too: bool = True) -> DataFrame:
    """Missing or empty values of required columns, or of any Unicode white space alone."""
    return all_violations(
        violation(df, "missing", id_col, F.coalesce((F.length(strip(c) if blank_too else F.col(c)) == 0), F.lit(True)), F.lit(c)) for c in columns
    )


def unique(df: DataFrame, id_col: str) -> DataFrame:
    repeated = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violation(repeated, "repeated_id", id_col, F.lit(True), F.col("n"))


def one_of(df: DataFrame, id_col: str, column: str, allowed: Iterable[str]) -> DataFrame:
    return violation(df, "unknown_value", id_col, ~F.col(column).isin(*allowed), F.concat_ws("=", F.lit(column), F.coalesce(column, F.lit("null"))))


def unknown_sources(df: DataFrame, id_col: str, source: str, registry: DataFrame, registry_source: str = "source_id") -> DataFrame:
    """Rows whose source the registry doesn't hold."""
    known = registry.select(F.col(registry_source).alias(source)).distinct()
    return violation(df.join(known, source, "left_anti"), "unknown_source", id_col, F.lit(True), F.col(source))


def lane_mismatches(df: DataFrame, id_col: str, source: str, lane: str, registry: DataFrame) -> DataFrame:
    """Rows whose lane isn't that of their source, or whose source is blocked."""
    policy = registry.select(F.col("source_id").alias(source), F.col("rights_lane").alias("__lane"))
    joined = df.join(policy, source)
    return violation(joined, "lane_mismatch", id_col, ~F.col(lane).eqNullSafe(F.col("__lane")), F.concat_ws("/", lane, "__lane")).unionByName(
        violation(joined.where(F.col("__lane") == "blocked"), "blocked_source", id_col, F.lit(True), F.col(source))
    )


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(column, side): values in one frame only."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def candidate_integrity(df: DataFrame, id_col: str) -> DataFrame:
    """Candidates whose fields are missing, malformed or don't agree with their text.

    Hashes and fingerprint are computed again from the text; rows of null text have only
    their missing fields reported.
    """
    fields = ("record_id", "text", "language", "source_id", "artifact_id", "source_group_id", "partition", "rights_lane", "content_sha256", "dedup_fingerprint", "simhash64_hex")
    base = df.select(id_col, *fields)
    filled = base.where(F.col("text").isNotNull())
    return all_violations([
        required(base, id_col, fields, blank_too=False),
        one_of(base.where("partition is not null"), id_col, "partition", PARTITIONS),
        one_of(base.where("rights_lane is not null"), id_col, "rights_lane", LANES),
        one_of(base.where("language is not null"), id_col, "language", LANGUAGES),
        violation(filled.where("content_sha256 is not null"), "content_sha256", id_col, ~sha256_valid("content_sha256") | (F.col("content_sha256") != content_sha256("text"))),
        violation(filled.where("dedup_fingerprint is not null"), "dedup_fingerprint", id_col, F.lower("dedup_fingerprint") != dedup_fingerprint("text")),
        violation(filled.where("simhash64_hex is not null"), "simhash64", id_col, from_hex("simhash64_hex") != simhash64("text")),
    ])


def promotable(source_lane: Column | str, target_lane: Column | str) -> Column:
    """Whether a checkpoint may move between lanes: the same lane, or release_safe to research_only."""
    a = F.col(source_lane) if isinstance(source_lane, str) else source_lane
    b = F.col(target_lane) if isinstance(target_lane, str) else target_lane
    return a.isin("release_safe", "research_only") & ((a == b) | ((a == "release_safe") & (b == "research_only")))


def eligible(df: DataFrame, status: str = "audit_status", conditional: bool = False) -> DataFrame:
    """Sources that are approved, or also those approved with conditions."""
    return df.where(F.col(status).isin(*(["approved", "conditional"] if conditional else ["approved"])))


def exclude_benchmarks(df: DataFrame, fingerprint: str, never_train: DataFrame, never_fingerprint: str) -> DataFrame:
    """Rows that resemble no never-train text by fingerprint."""
    known = never_train.select(F.col(never_fingerprint).alias(fingerprint)).where(F.col(fingerprint).isNotNull()).distinct()
    return df.join(known, fingerprint, "left_anti")
