"""Sampling and byte budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.sampling import ppm_selected


def ppm_sample(df: DataFrame, id_col: str, seed: str, parts_per_million: int) -> DataFrame:
    """Rows in the reproducible sample of a seed."""
    return df.where(ppm_selected(seed, F.col(id_col).cast("string"), parts_per_million))


def select_bytes(df: DataFrame, by: list[str], rank: Column, size: Column, target: Column | int) -> DataFrame:
    """Rows in rank order while the total before a row is under the target.

    The row that crosses the target is included.  Ranks are hex digests: their first
    digits split every group into ordered buckets, at least four for each shuffle
    partition, whose totals are accumulated first, so no task holds a whole group.
    """
    if isinstance(target, int) and target <= 0:
        raise ValueError("the target must be positive")
    digits = max(2, math.ceil(math.log(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)))
    rows = df.withColumns({"__rank": rank, "__size": F.coalesce(size, F.lit(0)).cast("bigint"), "__bucket": F.substring(rank, 1, digits)})
    sums = rows.groupBy(*by, "__bucket").agg(F.sum("__size").alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    same = F.col("__bucket") == F.col("__b")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    inside = Window.partitionBy(*by, "__bucket").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(base, same)
    before = F.col("__base") + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    return joined.withColumn("__before", before).where(F.col("__before") < target).select(*df.columns)


def balance_bytes(df: DataFrame, group: str, rank: Column, size: Column) -> DataFrame:
    """Each group cut to the size of the smallest: groups at or below it stay whole."""
    totals = df.groupBy(group).agg(F.sum(size).alias("__total"))
    goal = totals.agg(F.min("__total").alias("__goal"))
    # one row with one row: a scalar subquery, not a join of tables
    wanted = df.join(F.broadcast(goal))
    return select_bytes(wanted, [group], rank, size, F.col("__goal")).select(*df.columns)
