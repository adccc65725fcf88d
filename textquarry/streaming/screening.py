"""Streams: stateless screening and exact deduplication within a watermark.

The ordered greedy plan depends on the whole order of records and is no stream operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.sampling import partition_of
from textquarry.functions.text import dedup_fingerprint
from textquarry.operators.screening import screen, status


def screened(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with status and findings."""
    return stream.withColumn("__s", screen(text)).withColumns({"status": status("__s.disposition"), "findings": F.col("__s.findings.code")}).drop("__s")


def partitioned(stream: DataFrame, source: str, group: str) -> DataFrame:
    return stream.withColumn("partition", partition_of(source, group))


def first_copies(stream: DataFrame, time: str, delay: str, text: str = "text") -> DataFrame:
    """Rows whose fingerprint didn't occur within the watermark; the state is bounded by the delay."""
    return stream.withColumn("dedup_fingerprint", dedup_fingerprint(text)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["dedup_fingerprint"])


def counts(stream: DataFrame, time: str, delay: str, window: str, *by: str) -> DataFrame:
    """Rows of each window and key; late rows count until the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("records"))
