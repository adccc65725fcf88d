"""Joins whose hot keys are split by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is hot; there are at most 1/HOT_SHARE of them.
HOT_SHARE = 0.001
SALTS = 64


def heavy_keys(counts: DataFrame, keys: list[str], n: str = "n", least: int = 1, share: float = HOT_SHARE) -> DataFrame:
    """Keys with at least ``share`` of all rows and ``least`` rows: no more than 1/share, so fit to broadcast.

    ``counts``: one row for each key with its number of rows.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    return counts.where(F.col(n) >= max(least, share * total, 1)).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join on keys (nulls equal) where the left rows of heavy keys are spread over ``salts`` tasks.

    ``right`` has one row for each key; only its heavy rows (bounded, see
    :func:`heavy_keys`) are repeated for every salt.  ``spread``: a column of ``left`` that
    tells its rows apart.
    """
    names = [f"__h{i}" for i in range(len(keys))]
    few = F.broadcast(heavy.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.lit(True).alias("__heavy")))

    def marked(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k, n in zip(keys, names):
            same &= df[k].eqNullSafe(few[n])
        return df.join(few, same, "left").drop(*names)

    a = marked(left).withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0).cast("bigint"))).drop("__heavy")
    every = F.array(*[F.lit(x).cast("bigint") for x in range(salts)])
    b = marked(right).withColumn("__s", F.explode(F.when(F.col("__heavy"), every).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("__heavy")
    b = b.withColumnsRenamed(dict(zip(keys, names)))
    on = a["__salt"] == b["__s"]
    for k, n in zip(keys, names):
        on &= a[k].eqNullSafe(b[n])
    return a.join(b, on, "left").drop("__salt", "__s", *names)


def heavy_bound(rows: int, least: int = 10_000) -> float:
    """Rows from which a key is heavy, of about ``rows`` in all."""
    return max(least, HOT_SHARE * rows)


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, spread: Column) -> DataFrame:
    """:func:`salted_join` if there is a heavy key, and the plain join, which needs no shuffle by salt, if there is none."""
    if not heavy.isEmpty():
        return salted_join(left, right, keys, heavy, spread)
    names = [f"__r{i}" for i in range(len(keys))]
    renamed = right.withColumnsRenamed(dict(zip(keys, names)))
    on = F.lit(True)
    for k, n in zip(keys, names):
        on &= left[k].eqNullSafe(renamed[n])
    return left.join(renamed, on, "left").drop(*names)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, rows: int, least: int = 10_000) -> DataFrame:
    """:func:`join_heavy` by the heavy keys of ``left``, which has about ``rows`` rows and should lie in the shared folder.

    A key is heavy from ``least`` rows and HOT_SHARE of all on, so the heavy keys are at
    most 1/HOT_SHARE whatever the data; they are counted with map-side combine.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return join_heavy(left, right, keys, counts.where(F.col("n") >= heavy_bound(rows, least)).select(*keys), spread)
