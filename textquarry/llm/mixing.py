"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.running import running_total


def supply(items: DataFrame, slices: list[str], size: str) -> DataFrame:
    """Items and total size of each slice; null and negative sizes count as 0."""
    return items.groupBy(*slices).agg(F.count(F.lit(1)).alias("items"), F.sum(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))).alias("supply"))


def targets(items: DataFrame, plan: DataFrame, slices: list[str], size: str) -> DataFrame:
    """The plan with need, supply and the expected copies of each item of a slice.

    ``plan``: mix_id, the slice columns, target_share, max_repeats, total_tokens.  The
    expected copies are need / supply, at most max_repeats; null shares, totals and repeats
    count as 0, other columns of the plan are left out.  A null slice column matches
    nothing.  A slice without items has
    supply 0 and no copies.
    """
    have = supply(items, slices, size)
    need = plan.select("mix_id", *slices, "target_share", "max_repeats", "total_tokens").withColumn("need", F.coalesce(F.col("target_share") * F.col("total_tokens"), F.lit(0.0)))
    cap = F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    return (
        need.join(have, slices, "left")
        .withColumns({"supply": F.coalesce("supply", F.lit(0)), "items": F.coalesce("items", F.lit(0))})
        .withColumns({
            "expected": F.when(F.col("supply") > 0, F.least(F.col("need") / F.col("supply"), cap.cast("double"))).otherwise(0.0),
            "most": cap * F.col("supply"),
        })
    )


def mix(items: DataFrame, plan: DataFrame, slices: list[str], item: str, size: str, seed: int = 1) -> DataFrame:
    """The copies that make up each mix: mix_id, slices, ``item``, ``size``, copy_no (from 1).

    Systematic sampling: the expected copies of the items of a slice are summed up in a
    fixed pseudo-random order, one random offset is added for each mix and slice, and an
    item comes out once for each integer its interval crosses.  So each slice gives its
    expected number of copies, rounded up or down, and no item more than max_repeats.
    The rank of an item is a two-level running total; a slice with a third of all rows
    is no hot spot.  Items of null or negative size count as size 0, and they are sampled
    like others; repeated items are separate items.
    """
    goal = targets(items, plan, slices, size).where("expected > 0").select("mix_id", *slices, "expected")
    ranked = running_total(items.select(*slices, item, size), slices, [item, size], F.lit(1), "rank")
    offset = F.pmod(F.xxhash64(F.lit(seed), "mix_id", *slices), F.lit(1 << 30)) / float(1 << 30)
    # every item of a slice expects the same copies: the prefix sum is rank * expected
    before = F.floor(F.col("rank") * F.col("expected") + offset)
    after = F.floor((F.col("rank") + 1) * F.col("expected") + offset)
    return (
        ranked.join(goal, slices)
        .withColumn("copies", (after - before).cast("int"))
        .where("copies > 0")
        .select("mix_id", *slices, item, F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).alias(size), F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))
    )


def shares(items: DataFrame, plan: DataFrame, slices: list[str], item: str, size: str, seed: int = 1) -> DataFrame:
    """What each slice of each mix was to give and gives: tokens, share, and whether it falls short.

    ``short`` is read off the copies drawn: everything came out as often as max_repeats
    allows, and still the tokens are fewer than the need.
    """
    goal = targets(items, plan, slices, size)
    given = mix(items, plan, slices, item, size, seed).groupBy("mix_id", *slices).agg(F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("copies"))
    used = F.coalesce("tokens", F.lit(0))
    total = given.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    return (
        goal.join(given, ["mix_id", *slices], "left")
        .join(total, "mix_id", "left")
        .select(
            "mix_id", *slices, "target_share", "need", "supply", "max_repeats", "expected", ((used >= F.col("most")) & (F.col("need") > used)).alias("short"),
            F.coalesce("copies", F.lit(0)).alias("copies"), used.alias("tokens"), F.coalesce(F.try_divide("tokens", "mix_tokens"), F.lit(0.0)).alias("actual_share"),
        )
    )
