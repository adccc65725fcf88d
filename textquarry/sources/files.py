"""Strict readers for record files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textquarry.functions.keys import strip
from textquarry.functions.sampling import partition_of
from textquarry.functions.state import cut
from textquarry.functions.text import clean_text, dedup_fingerprint
from textquarry.operators.dedup import keep_first
from textquarry.operators.registry import all_violations, one_of, require, required, unique

#: Fields of corpus records and of benchmark cases.
TEXT_RECORD = "record_id string, text string, language string, source_id string, license string, partition string"
BENCHMARK_CASE = "case_id string, language string, category string, text string"
CORPUS_LANGUAGES = ("th", "en", "mixed", "other")
PARTITIONS = ("train", "validation", "holdout")


class SourceError(ValueError):
    """A file doesn't hold what it should."""


def json_lines(spark: SparkSession, path: str, schema: str | StructType, id_col: str = "record_id", allowed: dict[str, tuple[str, ...]] | None = None, strict: bool = True) -> DataFrame:
    """Records of a JSON Lines file under a fixed schema; blank lines are skipped.

    All fields but the text come without surrounding white space.  ``strict`` fails on
    broken JSON, missing or blank fields, repeated ids and values outside the allowed ones,
    before anything is returned.
    """
    lines = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    lines = lines.select(*[strip(c).alias(c) if c != "text" and kind == "string" else F.col(c) for c, kind in lines.dtypes])
    if strict:
        rules = [required(lines, id_col, lines.columns), unique(lines, id_col)]
        rules += [one_of(lines, id_col, c, v) for c, v in (allowed or {}).items()]
        require(all_violations(rules), path)
    return lines


def corpus(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return json_lines(spark, path, TEXT_RECORD, allowed={"language": CORPUS_LANGUAGES, "partition": PARTITIONS}, strict=strict)


def corpus_partition(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """One partition of a corpus file; an unknown partition is an error."""
    if partition not in PARTITIONS:
        raise SourceError(f"unknown partition {partition}")
    return corpus(spark, path).where(F.col("partition") == partition)


def benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    cases = json_lines(spark, path, BENCHMARK_CASE, "case_id")
    if cases.isEmpty():
        raise SourceError(f"{path} holds no cases")
    return cases


def in_file_order(df: DataFrame, name: str = "position") -> DataFrame:
    """A file-based frame with a column that sorts its rows in file order.

    Made of path, split offset and the row's number within its task: no shuffle, and the
    same order on every run.
    """
    here = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select("*", here.alias(name))


def shard_rows(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet shard with the number of each row in its file."""
    df = spark.read.parquet(path)
    return df.select(*(columns or df.columns), F.col("_metadata.row_index").alias("file_row_number"))


def wiki_dump(spark: SparkSession, root: str, prefix: str = "WIKI-", language: str = "th", license: str = "cc-by-sa-4.0", source_id: str = "wiki") -> DataFrame:
    """Articles of extracted wiki files (wiki_* at any depth); rows without id or text are skipped."""
    raw = spark.read.schema("id string, revid string, url string, title string, text string").option("recursiveFileLookup", "true").option("pathGlobFilter", "wiki_*").json(root)
    cleaned = raw.withColumn("text", clean_text("text")).where((F.length("id") > 0) & (F.length("text") > 0))
    record = F.concat(F.lit(prefix), F.col("id"), F.when(F.length("revid") > 0, F.concat(F.lit("-"), F.col("revid"))).otherwise(""))
    return cleaned.select(
        record.alias("record_id"), F.lit(source_id).alias("source_id"), dedup_fingerprint("text").alias("source_group_id"), "text",
        F.lit(language).alias("language"), F.lit(license).alias("license"), F.coalesce("url", F.lit("")).alias("source_url"),
    )


def sentences(spark: SparkSession, path: str, code: str, clean: bool = True) -> DataFrame:
    """(sentence_id, code, text) of a tab-separated file, plain or bz2; the text may hold tabs.

    Empty lines and texts are skipped; a line of fewer fields or another code is an error.
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    parts = F.split("value", "\t", 3)
    rows = lines.select(F.get(parts, F.lit(0)).alias("sentence_id"), F.get(parts, F.lit(1)).alias("code"), F.get(parts, F.lit(2)).alias("text"))
    bad = rows.where(F.col("text").isNull() | (F.col("code") != code)).limit(1).collect()
    if bad:
        raise SourceError(f"{path}: line of sentence {bad[0]['sentence_id']} has no three fields or another code than {code}")
    return rows.withColumn("text", clean_text("text") if clean else F.col("text")).where(F.length("text") > 0)


def first_sentences(spark: SparkSession, path: str, code: str) -> DataFrame:
    """Uncleaned sentences, of each normal text the first in the file."""
    lines = in_file_order(spark.read.text(path)).where(F.length("value") > 0)
    parts = F.split("value", "\t", 3)
    rows = lines.select(F.get(parts, F.lit(0)).alias("sentence_id"), F.get(parts, F.lit(1)).alias("code"), F.get(parts, F.lit(2)).alias("text"), "position")
    if not rows.where(F.col("text").isNull() | (F.col("code") != code)).isEmpty():
        raise SourceError(f"{path}: a line has no three fields or another code than {code}")
    named = rows.where(F.length("text") > 0).withColumn("dedup_fingerprint", dedup_fingerprint("text"))
    return keep_first(named, ["dedup_fingerprint"], ["position"]).select("sentence_id", "text", "dedup_fingerprint")


def shard(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "text", "language", "language_score")) -> DataFrame:
    """A Parquet shard; the columns named must be there."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SourceError(f"{path} lacks {', '.join(missing)}")
    return df


def shard_in_order(spark: SparkSession, path: str, key: str, *columns: str) -> DataFrame:
    """A shard's rows with their place (row_number, from 0) in order of a unique key."""
    return numbered(spark.read.parquet(path).select(*(columns or (key,))), key)


def numbered(df: DataFrame, key: str, name: str = "row_number") -> DataFrame:
    """Rows with their number in order of a unique key.

    The rows are range-partitioned and sorted within partitions, once, in the shared
    folder; a row's number is its place in its partition and the rows of those before, of
    which there is one count each.
    """
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumns({"__part": F.spark_partition_id(), "__at": low}))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # one row for each partition
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def wiki_sample(spark: SparkSession, root: str, lane: str, **options) -> DataFrame:
    """Articles of a wiki dump, of each normal text the one with the smallest record id, with their lane."""
    articles = wiki_dump(spark, root, **options).withColumn("dedup_fingerprint", F.col("source_group_id"))
    return keep_first(articles, ["dedup_fingerprint"], ["record_id"]).withColumn("rights_lane", F.lit(lane))


def pilot_sentences(spark: SparkSession, path: str, code: str, source_id: str) -> DataFrame:
    """All uncleaned sentences of a file with fingerprint and partition, copies included."""
    rows = sentences(spark, path, code, clean=False).withColumn("dedup_fingerprint", dedup_fingerprint("text"))
    return rows.withColumn("partition", partition_of(F.lit(source_id), "dedup_fingerprint"))


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows, and nulls of each column, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def config(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """One JSON object as one row; another schema_version is an error."""
    df = spark.read.option("multiLine", "true").json(path)
    if "schema_version" not in df.columns or df.where(F.col("schema_version") == version).isEmpty():
        raise SourceError(f"{path} is no object of schema_version {version}")
    return df


def external_path(uri: str, root: str, namespace: str) -> str:
    """Path of external://namespace/a/b under a root; nothing outside it."""
    prefix = f"external://{namespace}/"
    rest = uri.removeprefix(prefix) if uri.startswith(prefix) else ""
    parts = rest.split("/")
    if not rest or any(p in ("", ".", "..") for p in parts):
        raise SourceError(f"not an address in {namespace}: {uri}")
    path = os.path.realpath(os.path.join(root, *parts))
    if os.path.commonpath([path, os.path.realpath(root)]) != os.path.realpath(root):
        raise SourceError(f"{uri} leads out of {root}")
    return path
