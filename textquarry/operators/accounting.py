"""Accounting: grouping sets, capacities, readiness and budgets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.operators.registry import CATEGORIES, VISIBLE


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """One aggregation over several groupings; columns outside a grouping are null.

    ``grouping`` names the columns of each result row's set ("overall" for none), which
    tells a null value from a column left out.
    """
    keys = list(dict.fromkeys(c for s in sets for c in s))
    marked = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys])
    mark = [F.when(F.grouping(c) == 0, F.lit(c)) for c in keys]
    name = F.concat_ws("+", *mark) if mark else F.lit("")
    out = marked.agg(name.alias("grouping"), *aggregates)
    return out.withColumn("grouping", F.when(F.col("grouping") == "", "overall").otherwise(F.col("grouping")))


def share(part: Column, whole: Column) -> Column:
    """Guarded ratio: 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def audit_aggregates(status: str = "status", tokens: str = "tokens") -> list[Column]:
    """Records, characters, bytes, tokens, and records and tokens by status."""
    own = [
        F.count(F.lit(1)).alias("records"), F.sum("characters").alias("characters"), F.sum("utf8_bytes").alias("utf8_bytes"), F.sum(tokens).alias("tokens"),
    ]
    for s in ("accept", "quarantine", "reject"):
        own.append(F.count_if(F.col(status) == s).alias(f"{s}_records"))
        own.append(F.coalesce(F.sum(F.when(F.col(status) == s, F.col(tokens))), F.lit(0)).alias(f"{s}_tokens"))
    return own


def visible_lanes(df: DataFrame, lane: str) -> DataFrame:
    """Each row once for each target lane that may use it (target_lane)."""
    targets = F.array_compact(F.array(*[F.when(F.col(lane).isin(*lanes), target) for target, lanes in VISIBLE.items()]))
    return df.withColumn("target_lane", F.explode(targets))


def capacity(df: DataFrame, lane: str, category: str, tokens: str, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(target_lane, category, tokens) for every lane and category; 0 where there is nothing."""
    spark = df.sparkSession
    frame = spark.createDataFrame([(t, c) for t in VISIBLE for c in categories], "target_lane string, category string")
    sums = visible_lanes(df, lane).groupBy("target_lane", F.col(category).alias("category")).agg(F.sum(tokens).alias("tokens"))
    return frame.join(sums, ["target_lane", "category"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))


@dataclass(frozen=True)
class Mixture:
    """Targets of a mixture, in tokens."""

    thai: int
    english: int
    technical: int
    domain: int
    domain_cap: int

    @property
    def total(self) -> int:
        return self.thai + self.english + self.technical + self.domain


def readiness(cap: DataFrame, goal: Mixture) -> DataFrame:
    """Gaps and readiness of each lane.

    What the domain lacks under its cap is made up by technical text; the total gap counts
    all that is available, uncapped.
    """
    c = F.col
    wide = cap.groupBy("target_lane").agg(*[F.coalesce(F.sum(F.when(c("category") == k, c("tokens"))), F.lit(0)).alias(a) for k, a in zip(CATEGORIES, ("thai", "english", "technical", "domain"))])
    used = F.least(c("domain"), F.lit(goal.domain_cap))
    need = F.lit(goal.technical + goal.domain) - used
    gap = lambda x: F.greatest(F.lit(0).cast("bigint"), x.cast("bigint"))
    gaps = wide.select(
        "target_lane", "thai", "english", "technical", "domain", used.cast("bigint").alias("domain_used"), need.cast("bigint").alias("technical_required"),
        gap(goal.thai - c("thai")).alias("thai_gap"), gap(goal.english - c("english")).alias("english_gap"), gap(need - c("technical")).alias("technical_gap"),
        gap(goal.total - (c("thai") + c("english") + c("technical") + c("domain"))).alias("total_gap"),
    )
    return gaps.withColumn("ready", (c("thai_gap") + c("english_gap") + c("technical_gap") + c("total_gap")) == 0)


def budget_plan(df: DataFrame, target: Column, tokens_per_step: int, warmup_fraction: float) -> DataFrame:
    """Steps, warm-up, scheduled tokens and overshoot for a token target."""
    if tokens_per_step < 1 or not 0 <= warmup_fraction < 1:
        raise ValueError("tokens_per_step >= 1 and 0 <= warmup_fraction < 1 are required")
    steps = F.ceil(target / F.lit(tokens_per_step)).cast("bigint")
    return df.withColumns({"steps": steps}).withColumns({
        "warmup_steps": F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("steps") * F.lit(warmup_fraction)).cast("bigint")),
        "scheduled_tokens": F.col("steps") * tokens_per_step,
    }).withColumn("overshoot", F.col("scheduled_tokens") - target)


def token_gap(total: Column, target: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), (target - total).cast("bigint"))


def planning_capacity(baseline: DataFrame, derived: DataFrame, deduplicated: bool) -> DataFrame:
    """Capacity of what is there and what was derived, both (lane, category, tokens); ``planning_only`` until sources were deduplicated against each other."""
    both = baseline.select("lane", "category", "tokens").unionByName(derived.select("lane", "category", "tokens"))
    return capacity(both, "lane", "category", "tokens").withColumn("planning_only", F.lit(not deduplicated))


def inventory(df: DataFrame, tokens: str, goal: int) -> DataFrame:
    """Records, bytes and tokens in all, by language, by partition and by both, and the share and gap to a target."""
    sets = [[], ["language"], ["partition"], ["partition", "language"]]
    out = grouping_sets(df, sets, [F.count(F.lit(1)).alias("records"), F.sum("utf8_bytes").alias("utf8_bytes"), F.sum(tokens).alias("tokens")])
    return out.withColumns({"fraction": F.round(F.col("tokens") / F.lit(goal), 12), "gap": token_gap(F.col("tokens"), F.lit(goal))})


def shard_counters(rows: DataFrame, selected: DataFrame, id_col: str) -> DataFrame:
    """(counter, key, value) of a materialised shard.

    ``rows``: all rows of the shard with their text and whether the sample ``selected``
    them; ``selected``: what materialise gives, with tokens.  Findings are counted before
    exact duplicates are left out, statuses after.
    """
    blank = F.coalesce(F.length(F.trim(F.col(id_col).cast("string"))), F.lit(0)) == 0
    top = rows.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(blank).alias("rows_missing_id"), F.count_if(~blank & F.col("selected")).alias("rows_selected"),
        F.count_if(~blank & ~F.col("selected")).alias("rows_not_selected"), F.count_if(~blank & F.col("selected") & F.col("text").isNull()).alias("rows_missing_text"),
    )
    done = selected.agg(
        F.count(F.lit(1)).alias("rows_processed"), F.count_if(F.col("status") == "exact_duplicate").alias("exact_duplicates"), F.count_if(F.col("status") == "near_duplicate").alias("near_duplicates"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_records") for s in ("accept", "quarantine", "reject")],
    )

    def long(one: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("counter"), F.lit("").alias("key"), F.col(c).cast("bigint").alias("value")) for c in one.columns])
        return one.select(F.inline(pairs))

    def by(df: DataFrame, name: str, key: str, value: Column) -> DataFrame:
        return df.groupBy(key).agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("counter"), F.col(key).cast("string").alias("key"), "value")

    kept = selected.where(F.col("status").isin("accept", "quarantine", "reject"))
    accepted = selected.where("status = 'accept'")
    return (
        long(top).unionByName(long(done))
        .unionByName(by(kept, "tokens_by_status", "status", F.sum("tokens")))
        .unionByName(by(accepted, "tokens_by_partition", "partition", F.sum("tokens")))
        .unionByName(by(accepted, "records_by_partition", "partition", F.count(F.lit(1))))
        .unionByName(by(selected.select(F.explode("findings").alias("finding")), "findings", "finding", F.count(F.lit(1))))
        .unionByName(by(selected.where("status = 'near_duplicate'"), "near_distances", "hamming_distance", F.count(F.lit(1))))
    )


def baseline_counters(rows: DataFrame) -> DataFrame:
    """(counter, key, value) of screened rows (status, partition, tokens, utf8_bytes, findings) that weren't deduplicated; findings are of all rows."""
    accepted = rows.where("status = 'accept'")
    parts = [
        rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit("input_records").alias("counter"), F.lit("").alias("key"), "value"),
        rows.groupBy("status").agg(F.count(F.lit(1)).alias("value")).select(F.concat("status", F.lit("_records")).alias("counter"), F.lit("").alias("key"), "value"),
        accepted.groupBy("partition").agg(F.sum("tokens").alias("value")).select(F.lit("tokens").alias("counter"), F.col("partition").alias("key"), "value"),
        accepted.groupBy("partition").agg(F.sum("utf8_bytes").alias("value")).select(F.lit("utf8_bytes").alias("counter"), F.col("partition").alias("key"), "value"),
        rows.select(F.explode("findings").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("value")).select(F.lit("findings").alias("counter"), "key", "value"),
    ]
    return reduce(DataFrame.unionByName, [p.withColumn("value", F.col("value").cast("bigint")) for p in parts])


def densities(df: DataFrame, tokens: str, stored: Column) -> DataFrame:
    """Tokens for each byte stored, each GiB stored and each byte of text; ``stored``: bytes on disk of the whole; 0 where there is nothing."""
    sums = df.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum("utf8_bytes"), F.lit(0)).alias("utf8_bytes"), F.coalesce(F.max(stored), F.lit(0)).alias("stored_bytes"))
    return sums.withColumns({
        "tokens_per_stored_byte": share(F.col("tokens"), F.col("stored_bytes")), "tokens_per_gib": share(F.col("tokens") * F.lit(float(1 << 30)), F.col("stored_bytes")),
        "tokens_per_text_byte": share(F.col("tokens"), F.col("utf8_bytes")),
    })
