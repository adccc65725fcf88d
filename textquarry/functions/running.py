"""Running totals that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, by: list[str], order: list[str], weight: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Total of ``weight`` over all rows of the same ``by`` that come before a row.

    The order within ``by`` is pseudo-random but fixed: by hash of ``order``, then by
    ``order`` itself, which should name a row.  Hash buckets are summed first and their
    totals accumulated, so a hot ``by`` is spread over all buckets; only the bucket totals
    of one ``by`` (``buckets`` rows, by default four for each shuffle partition) meet in a
    task.  Null weights count as 0.
    """
    if buckets is None:
        buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.xxhash64(*order)
    rows = df.withColumns({"__w": F.coalesce(weight, F.lit(0)), "__h": place, "__bucket": F.pmod(place, F.lit(buckets))})
    sums = rows.groupBy(*by, "__bucket").agg(F.sum("__w").alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    same = F.col("__bucket") == F.col("__b")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    inside = Window.partitionBy(*by, "__bucket").orderBy("__h", *order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, same).withColumn(out, F.col("__base") + F.coalesce(F.sum("__w").over(inside), F.lit(0))).select(*df.columns, out)
