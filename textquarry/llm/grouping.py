"""Splits that keep related records together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.joins import heavy_bound, heavy_keys, join_heavy, salted_join, spread_join
from textquarry.functions.keys import key, strip
from textquarry.functions.state import cut
from textquarry.llm.components import components

#: Source group ids that relate nothing.
FILLERS = ("", "ungrouped")
#: Groups with at least this share of all rows are placed before all others; there are at most 1/share.
LARGE_SHARE = 0.001
#: Groups that one task places.
BUCKET_GROUPS = 5_000


def group_key(source_group_id: Column | str) -> Column:
    """Group id without case and white space; null for a filler."""
    g = key(source_group_id)
    return F.when(~g.isin(*FILLERS), g)


def page_key(url: Column | str) -> Column:
    """A page's address without scheme, case of the host, www., trailing slash, fragment and utm_ parameters."""
    whole = F.regexp_replace(strip(url), r"(?s)#.*$", "")
    rest = F.regexp_replace(whole, r"^(?i:[a-z][a-z0-9+.\-]*:)?//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~p.startswith("utm_"))
    page = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.length(page) > 0, page)


def named_hash(entity: Column) -> Column:
    """64-bit hash of an entity's name; null for null."""
    return F.when(entity.isNotNull(), F.xxhash64(entity))


def related(rows: DataFrame, row_id: str, entities: list[str]) -> DataFrame:
    """(row_id, group): rows that share a value in any of two entity columns, or a chain of them.

    The bipartite graph of records and entities is contracted first: a record with one
    entity hangs on it, one with both is an edge between them, and a second entity that
    meets one first entity only links nothing.  Minimum labels are then propagated over
    the remaining edges.  Rows without entities get a null group: they are alone.
    Repeated row ids may carry different entities; all of them count.  Rows are joined to
    their entities and groups with heavy ones spread by hand.
    """
    first, second = entities
    named = rows.select(
        row_id,
        F.when(F.col(first).isNotNull(), F.xxhash64(F.lit(0), first)).alias("e1"),
        F.when(F.col(second).isNotNull(), F.xxhash64(F.lit(1), second)).alias("e2"),
    )
    number = named.count()
    edges = cut(named.where("e1 is not null and e2 is not null").select("e1", "e2").distinct())
    owner = cut(edges.groupBy("e2").agg(F.min("e1").alias("owner"), F.max("e1").alias("other")))
    several = owner.where("owner < other").select("e2", F.lit(True).alias("several"))
    linking = spread_join(edges, several, ["e2"], F.col("e1"), number).where("several").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    label = components(linking)
    home = cut(spread_join(named, owner.select("e2", "owner"), ["e2"], F.col(row_id), number).select(row_id, F.coalesce("e1", "owner", "e2").alias("node")).distinct())
    return spread_join(home, label, ["node"], F.col(row_id), number).select(row_id, F.coalesce("label", "node").alias("group"))


def divided(rows: DataFrame, row_id: str, group: str, partition: Column, number: int | None = None) -> DataFrame:
    """(group_row_id, row_id) of all rows of groups that lie in more than one partition today.

    ``number``: about how many rows there are, if that is known.
    """
    p = rows.select(row_id, group, partition.alias("__p")).where(F.col(group).isNotNull())
    sums = p.groupBy(group).agg(F.min(row_id).alias("group_row_id"), F.min("__p").alias("low"), F.max("__p").alias("high"), F.count(F.lit(1)).alias("n"))
    split = cut(sums.where("low < high").select(group, "group_row_id", "n"))
    heavy = split.where(F.col("n") >= heavy_bound(rows.count() if number is None else number)).select(group)
    joined = join_heavy(p, split.drop("n"), [group], heavy, F.col(row_id))
    return joined.where("group_row_id is not null").select("group_row_id", row_id).distinct()


def place(vectors: list[dict], want: dict, names: list[str]) -> list[str]:
    """A split for each group, in the order given: where the labels' distribution then deviates least.

    ``vectors``: {label: rows} of each group; ``want``: {label: rows of each split}, whose
    sums are the labels' rows.  The deviation is the sum over labels and splits of
    (rows - wanted)**2 / wanted, over all labels at once; a group goes to the split that
    lowers it most, of equal ones to the first.
    """
    lack = {k: np.array(v, float) for k, v in want.items()}
    scale = {k: 1 / np.maximum(np.array(v, float), 1e-9) for k, v in want.items()}
    chosen = []
    for vector in vectors:
        cost = np.zeros(len(names))
        for k, n in vector.items():
            cost += (n * n - 2 * n * lack[k]) * np.minimum(scale[k], 1.0)
        best = int(cost.argmin())
        for k, n in vector.items():
            lack[k][best] -= n
        chosen.append(names[best])
    return chosen


def _placed(rows: DataFrame, group: str, label: str, size: str, bucket: str, names: list[str]) -> DataFrame:
    """(group, split): :func:`place` for the groups of each bucket, largest first.

    ``rows``: group, label, size, bucket, and for each split the share of the label's rows
    in this bucket that it should get, __share_0, __share_1, ...
    """
    shares = [f"__share_{i}" for i in range(len(names))]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known = frame[label].fillna("").astype(str).where(frame[label].notna(), "\0null")
        want: dict = {}
        for k, n, *s in zip(known, frame[size], *(frame[c] for c in shares)):
            want[k] = want.get(k, 0.0) + n * np.array(s, float)
        vectors: dict = {}
        for g, k, n in zip(frame[group], known, frame[size]):
            own = vectors.setdefault(g, {})
            own[k] = own.get(k, 0) + n
        order = sorted(vectors, key=lambda g: (-sum(vectors[g].values()), g))
        return pd.DataFrame({group: order, "split": place([vectors[g] for g in order], want, names)})

    kind = rows.schema[group].dataType.simpleString()
    return rows.groupBy(bucket).applyInPandas(run, f"`{group}` {kind}, split string")


def assign(counts: DataFrame, group: str, label: str, size: str, shares: dict[str, float]) -> DataFrame:
    """(group, split): whole groups to splits so that every label is distributed as the shares say.

    ``counts``: (group, label, size), the rows of each label in each group, all of which
    count.  The rule is :func:`place`.  It needs every group it places in one task, so
    groups are divided into buckets of about BUCKET_GROUPS by a hash; groups that would
    outweigh a bucket, those with at least LARGE_SHARE of all rows (at most 1/LARGE_SHARE),
    make a bucket of their own that is placed first, and the others aim at what each label
    still lacks.  Labels stay in frames; neither their number nor a group's is bounded.
    """
    names = list(shares)
    whole = sum(shares.values())
    sums = cut(counts.groupBy(group).agg(F.sum(size).alias("__rows")))
    number = sums.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__rows"), F.lit(0)).alias("rows")).first()
    least = max(2.0, LARGE_SHARE * number["rows"])
    buckets = max(1, -(-number["n"] // BUCKET_GROUPS))
    where = F.when(F.col("__rows") >= least, F.lit(-1)).otherwise(F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int"))
    rows = cut(counts.join(sums.select(group, where.alias("__bucket")), group).select(group, label, size, "__bucket"))
    fixed = [F.lit(shares[s] / whole).alias(f"__share_{i}") for i, s in enumerate(names)]
    first = cut(_placed(rows.where("__bucket = -1").select("*", *fixed), group, label, size, "__bucket", names))
    # what each label lacks in each split after the large groups, as shares of its other rows
    taken = rows.where("__bucket = -1").join(first, group).groupBy(label).pivot("split", names).agg(F.sum(size))
    total = rows.groupBy(label).agg(F.sum(size).alias("__all"))
    have = taken.select(F.col(label).alias("__label"), *[F.coalesce(F.col(s), F.lit(0)).alias(f"__have_{i}") for i, s in enumerate(names)])
    left = total.join(have, total[label].eqNullSafe(have["__label"]), "left")
    lack = [F.greatest(F.col("__all") * F.lit(shares[s] / whole) - F.coalesce(f"__have_{i}", F.lit(0)), F.lit(0.0)) for i, s in enumerate(names)]
    all_lack = sum(lack[1:], lack[0])
    goal = left.select(F.col(label).alias("__label"), *[F.coalesce(F.try_divide(x, all_lack), F.lit(shares[s] / whole)).alias(f"__share_{i}") for i, (x, s) in enumerate(zip(lack, names))])
    small = rows.where("__bucket >= 0")
    # few labels hold most rows: heavy ones are spread, see salted_join
    heavy = heavy_keys(small.groupBy(label).agg(F.count(F.lit(1)).alias("n")), [label], least=1_000)
    aimed = salted_join(small, goal.withColumnRenamed("__label", label), [label], heavy, F.col(group))
    return first.unionByName(_placed(aimed, group, label, size, "__bucket", names))


def balance(counts: DataFrame, splits: DataFrame, group: str, label: str, size: str, shares: dict[str, float]) -> DataFrame:
    """(label, split, rows, share, target, deviation) of an assignment; deviation is share less target."""
    whole = sum(shares.values())
    target = F.element_at(F.create_map(*[F.lit(x) for s, v in shares.items() for x in (s, v / whole)]), F.col("split"))
    by = counts.join(splits, group).groupBy(label, "split").agg(F.sum(size).alias("rows"))
    total = by.groupBy(F.col(label).alias("__label")).agg(F.sum("rows").alias("__all"))
    joined = by.join(total, by[label].eqNullSafe(total["__label"]))
    return joined.select(label, "split", "rows", (F.col("rows") / F.col("__all")).alias("share"), target.alias("target")).withColumn("deviation", F.col("share") - F.col("target"))
