"""Queries of problems 5, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions.keys import key
from textquarry.functions.state import cut
from textquarry.llm.packing import pack, waste
from textquarry.llm.splitting import split_texts
from textquarry.llm.tokens import BYTES, budget_by_slice, count_tokens, encode_corpus
from textquarry.operators.dedup import keep_latest as latest
from textquarry.sources.tables import table

#: Most rows a table of limits or rules may have; they are read by the driver.
MOST_LIMITS = 1_000


def small_rows(df: DataFrame, most: int = MOST_LIMITS) -> list:
    """All rows of a table that must be small; raises if it isn't."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table of limits or rules")
    return rows


def accepted_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Right token count of every accepted record: the byte tokenizer over the whole text."""
    decisions = latest(
        table(spark, sf, "global_decision").select("canonical_id", "decided_at", "source_id", "language", "primary_category", "status"),
        "canonical_id", "decided_at",
    ).where(F.col("status") == "accept")
    counted = count_tokens(table(spark, sf, "global_candidate"), "canonical_id", "text", BYTES)
    return decisions.join(counted, "canonical_id", "left").select(
        "canonical_id", key("source_id").alias("source_id"), "language", "primary_category", F.coalesce("tokens", F.lit(0)).alias("tokens")
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Budget rows that need more tokens than their slice of accepted records has."""
    have = budget_by_slice(accepted_tokens(spark, sf), "source_id", "language", "primary_category")
    need = table(spark, sf, "token_budget").select("source_id", "language", "primary_category", "needed_tokens", key("source_id").alias("__source"))
    have = have.select(F.col("source_id").alias("__source"), F.col("language").alias("__lang"), F.col("primary_category").alias("__cat"), "tokens")
    same = (
        need["__source"].eqNullSafe(have["__source"])
        & need["language"].eqNullSafe(have["__lang"])
        & need["primary_category"].eqNullSafe(have["__cat"])
    )
    return (
        need.join(have, same, "left")
        .where(F.col("needed_tokens") > F.coalesce("tokens", F.lit(0)))
        .select("source_id", "language", "primary_category")
        .distinct()
    )


def p5_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted records and tokens by source, language and category."""
    return budget_by_slice(accepted_tokens(spark, sf), "source_id", "language", "primary_category")


def p5_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens of byte_bpe_50k by source, language and category."""
    docs = table(spark, sf, "documents").select("doc_id", "text", key("source").alias("source_id"), F.lower(F.col("lang")).alias("language"), "primary_category")
    slices = ("source_id", "language", "primary_category")
    return budget_by_slice(count_tokens(docs, "doc_id", "text", keep=slices), *slices)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def _containers(spark: SparkSession, sf: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    rule = table(spark, sf, "size_limit").where(F.col("use_for") == "container").select("limit_id", "max_tokens")
    limits = sorted((r[0], r[1]) for r in small_rows(rule))
    docs = table(spark, sf, "documents")
    sizes = count_tokens(docs, "doc_id", "text")
    return pack(sizes, "doc_id", "tokens", limits, docs.count()), limits


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Container of every document, or of its parts, for each container size."""
    return _containers(spark, sf)[0]


def p9_waste(spark: SparkSession, sf: str) -> DataFrame:
    """Unused room of each container size."""
    return waste(*_containers(spark, sf))


def p9_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Of each container size: documents placed, containers over it, documents divided without need, parts that don't follow on."""
    packed, limits = _containers(spark, sf)
    packed = cut(packed)
    capacity = F.element_at(F.create_map(*[F.lit(x) for pair in limits for x in pair]), F.col("limit_id"))
    over = packed.groupBy("limit_id", "container_id").agg(F.sum("part_tokens").alias("used")).groupBy("limit_id").agg(F.count_if(F.col("used") > capacity).alias("over"))
    by = packed.groupBy("limit_id", "doc_id").agg(F.sum("part_tokens").alias("size"), F.count(F.lit(1)).alias("parts"), F.max(F.col("first_token") + F.col("part_tokens")).alias("end"))
    docs = by.groupBy("limit_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("size") <= capacity) & (F.col("parts") > 1)).alias("divided_small"), F.count_if(F.col("size") != F.col("end")).alias("with_gaps")
    )
    return docs.join(over, "limit_id")


def p10_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Of each piece size: pieces over it, texts that their pieces don't cover from end to end, pieces whose text isn't the document's."""
    rule = {r[0]: r[1] for r in small_rows(table(spark, sf, "size_limit").where(F.col("use_for") == "piece").select("limit_id", "max_tokens"))}
    most = F.element_at(F.create_map(*[F.lit(x) for pair in rule.items() for x in pair]), F.col("limit_id"))
    docs = table(spark, sf, "documents").select("doc_id", F.char_length("text").alias("chars"), "text")
    pieces = p10_pieces(spark, sf).join(docs, "doc_id")
    told = pieces.select(
        "limit_id", "doc_id", "piece_no", "start_char", "end_char", "chars", (F.col("piece_tokens") > most).alias("over"),
        (F.substr("text", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int")) != F.col("piece_text")).alias("other"),
    )
    order = Window.partitionBy("limit_id", "doc_id").orderBy("piece_no")
    told = told.withColumn("gap", F.col("start_char") > F.coalesce(F.lag("end_char").over(order), F.lit(0)))
    by = told.groupBy("limit_id", "doc_id").agg(F.max(F.col("gap") | F.col("other")).alias("wrong"), F.max("end_char").alias("end"), F.max("chars").alias("chars"), F.count_if("over").alias("over"))
    return by.groupBy("limit_id").agg(F.sum("over").alias("pieces_over"), F.count_if(F.col("wrong") | (F.col("end") != F.col("chars"))).alias("wrong_documents"))


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered pieces of every document over a piece size, with the overlap asked for."""
    rule = table(spark, sf, "size_limit").where(F.col("use_for") == "piece").select("limit_id", "max_tokens", "overlap_tokens")
    limits = sorted((r[0], r[1], r[2] or 0) for r in small_rows(rule))
    return split_texts(table(spark, sf, "documents"), "doc_id", "text", limits)


QUERIES = {f.__name__: f for f in (p5_found, p5_slices, p5_documents, p8_ids, p9_containers, p9_waste, p9_checked, p10_pieces, p10_checked)}

_LATEST = r"""
WITH latest AS (
  SELECT DISTINCT ON (canonical_id) canonical_id, lower(regexp_replace(source_id, '^\s+|\s+$', '', 'g')) AS source_id, language, primary_category, status
  FROM (SELECT DISTINCT * FROM global_decision)
  ORDER BY canonical_id, decided_at DESC NULLS LAST
), slices AS (
  SELECT l.source_id, l.language, l.primary_category, count(*) AS records,
         CAST(coalesce(sum(octet_length(encode(coalesce(c.text, '')))), 0) AS BIGINT) AS tokens
  FROM latest l LEFT JOIN global_candidate c USING (canonical_id)
  WHERE l.status = 'accept' GROUP BY ALL
)
"""

SQL = {
    "p5_found": _LATEST
    + r"""SELECT DISTINCT b.source_id, b.language, b.primary_category FROM token_budget b
LEFT JOIN slices s ON lower(regexp_replace(b.source_id, '^\s+|\s+$', '', 'g')) = s.source_id AND b.language IS NOT DISTINCT FROM s.language
 AND b.primary_category IS NOT DISTINCT FROM s.primary_category
WHERE b.needed_tokens > coalesce(s.tokens, 0)""",
    "p9_checked": "SELECT limit_id, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS divided_small, 0 AS with_gaps, 0 AS over FROM size_limit WHERE use_for = 'container'",
    "p10_checked": "SELECT limit_id, 0 AS pieces_over, 0 AS wrong_documents FROM size_limit WHERE use_for = 'piece'",
    "p5_slices": _LATEST + "SELECT source_id, language, primary_category, records, tokens FROM slices",
}
