"""Deduplication: first of a group, near pairs by blocks of the fingerprint, and the ordered greedy plan."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.joins import heavy_keys, salted_join, spread_join
from textquarry.functions.state import cut
from textquarry.functions.text import bands, hamming

#: Order in which partitions and lanes are considered.
PARTITION_ORDER = {"holdout": 0, "validation": 1, "train": 2}
LANE_ORDER = {"release_safe": 0, "research_only": 1}
MAX_DISTANCE, BANDS = 3, 4


def keep_first(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group in the given order.

    A group's rows are never gathered: the minimum is aggregated with map-side combine.
    ``order`` should end in a unique column; null keys form a group of their own.
    """
    named = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in by]
    top = F.min_by(F.struct(*rest), F.struct(*named)) if rest else F.count(F.lit(1))
    return df.groupBy(*by).agg(top.alias("__first")).select(*by, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_latest(df: DataFrame, by: str, order: str) -> DataFrame:
    """The row of each ``by`` with the latest ``order``; plain repeats count once.

    Of different rows with an equal ``order`` the greatest by all columns stays, so the
    result does not depend on the partitioning.  A null ``order`` counts as the earliest.
    """
    rest = [c for c in df.columns if c not in (by, order)]
    top = F.max(F.struct(F.col(order), *rest)).alias("__top")
    return df.groupBy(by).agg(top).select(by, *[F.col(f"__top.{c}").alias(c) for c in (order, *rest)])


def band_rows(df: DataFrame, id_col: str, fingerprint: str, count: int = BANDS) -> DataFrame:
    """(id, fingerprint, band, value): the inverted index of fingerprints by equal bands."""
    return df.where(F.col(fingerprint).isNotNull()).select(id_col, fingerprint, F.inline(bands(fingerprint, count)))


def block_keys(fingerprint: Column | str, most: int = MAX_DISTANCE, take: int = 2) -> Column:
    """array<bigint>: one key for each choice of ``take`` of ``most + take`` blocks of the fingerprint.

    ``most`` differing bits lie in at most ``most`` blocks, so fingerprints within reach
    have a key in common.  With the defaults ten keys hold 25 bits or more, which
    unrelated fingerprints seldom share; a larger ``take`` gives more and longer keys.
    """
    if not (0 <= most <= 63 and take >= 1 and most + take <= 64):
        raise ValueError("0 <= most, 1 <= take and most + take <= 64 are required")
    f = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    count = most + take
    sizes = [64 // count + (b < 64 % count) for b in range(count)]
    starts = [sum(sizes[:b]) for b in range(count)]
    block = [F.shiftrightunsigned(f, starts[b]).bitwiseAND(F.lit((1 << sizes[b]) - 1)) if sizes[b] < 64 else f for b in range(count)]
    keys = []
    for number, chosen in enumerate(combinations(range(count), take)):
        key = F.lit(number).cast("bigint")
        for b in chosen:
            key = F.shiftleft(key, sizes[b]).bitwiseOR(block[b])
        keys.append(key)
    return F.array(*keys)


def _blocks_for(most: int) -> int:
    """Blocks that a key joins: keys of about 20 bits or more."""
    return 2 if most <= 4 else 3


def near_values(values: DataFrame, fingerprint: str, most: int = MAX_DISTANCE, against: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints within ``most`` bits, complete for every ``most``.

    Without ``against`` pairs of the values with a < b; with it pairs of a value and an
    unequal value of ``against`` (same column name).  Works on distinct values, so copies
    never meet; nulls match nothing.

    A value becomes one row for each of its keys (120 for seven bits), which size estimates
    don't know of: the values are spread before that, and the keys meet in a merge join,
    as neither side may be sent to the driver, however small its values look.
    """
    take = _blocks_for(most)
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias(name)).distinct()
        return distinct.repartition(tasks).select(name, F.explode(block_keys(name, most, take)).alias("key"))

    a, b = keyed(values, "a"), keyed(values if against is None else against, "b")
    met = a.hint("merge").join(b, "key").where("a < b" if against is None else "a != b").select("a", "b", hamming("a", "b").alias("distance"))
    return met.where(F.col("distance") <= most).distinct()


def near_matches(query: DataFrame, index: DataFrame, id_col: str, fingerprint: str, most: int = MAX_DISTANCE) -> DataFrame:
    """(query_id, match_id, distance): records of the index within reach of each query, itself excepted.

    Distinct values meet first; records are joined to the pairs of values afterwards.
    """
    q = query.where(F.col(fingerprint).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(fingerprint).alias("a"))
    i = index.where(F.col(fingerprint).isNotNull()).select(F.col(id_col).alias("match_id"), F.col(fingerprint).alias("b"))
    near = near_values(query, fingerprint, most, against=index)
    same = q.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("distance"))
    return q.join(near.unionByName(same), "a").join(i, "b").where("query_id != match_id").select("query_id", "match_id", "distance").distinct()


def priority(partition: Column | str, lane: Column | str) -> tuple[Column, Column]:
    """Ranks of partition and lane; null for an unknown one."""

    def rank(c: Column | str, order: dict[str, int]) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), c)

    return rank(partition, PARTITION_ORDER), rank(lane, LANE_ORDER)


def settle(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the nodes that are accepted when taken in order of rank.

    ``nodes``: (f, s, rank, ...), rank unique; a node is accepted unless an accepted one of
    smaller rank has its ``f``, its ``s``, or an ``s`` that ``pairs`` (a, b, both ways)
    joins to its own.  A node that comes first among all open nodes it touches is accepted
    and takes the others out.  Minima are kept by value, so nodes of one value never meet
    each other; only open nodes go on to the next round, which is written to the shared
    folder.
    """
    accepted = []
    open_ = cut(nodes)
    while True:
        first = open_.where("s is not null").groupBy("s").agg(F.min("rank").alias("least"))
        around = first.unionByName(pairs.join(first.withColumnRenamed("s", "b"), "b").select(F.col("a").alias("s"), "least"))
        near = around.groupBy("s").agg(F.min("least").alias("near_least"))
        exact = open_.where("f is not null").groupBy("f").agg(F.min("rank").alias("exact_least"))
        judged = cut(
            open_.join(near, "s", "left").join(exact, "f", "left")
            .withColumn("taken", (F.col("rank") <= F.coalesce("near_least", "rank")) & (F.col("rank") <= F.coalesce("exact_least", "rank")))
            .drop("near_least", "exact_least")
        )
        taken = judged.where("taken").select(*nodes.columns)
        accepted.append(taken)
        rest = judged.where("not taken").select(*nodes.columns)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, accepted)
        held = taken.where("s is not null").select("s")
        gone = held.unionByName(pairs.join(held.withColumnRenamed("s", "b"), "b").select(F.col("a").alias("s"))).distinct()
        open_ = cut(rest.join(gone, "s", "left_anti").join(taken.where("f is not null").select("f").distinct(), "f", "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, accepted)


def nodes_of(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(f, s, rank, name, n, extra...): the first of all rows (rank, name, f, s, extra...) of each pair of values, and their number."""
    top = rows.where("f is not null or s is not null").groupBy("f", "s").agg(F.min(F.struct("rank", "name", *extra)).alias("__top"), F.count(F.lit(1)).alias("n"))
    return top.select("f", "s", *[F.col(f"__top.{c}").alias(c) for c in ("rank", "name", *extra)], "n")


def decide_in_order(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, known_exact: DataFrame | None = None, known_near: DataFrame | None = None) -> DataFrame:
    """(id, name, f, s, rank, exact, distance, other) of all rows taken in order of rank; ``other`` is null for those accepted.

    ``rows``: (id, name, rank, f, s), rank unique; ``nodes``: :func:`nodes_of` them, cut;
    ``pairs``: (a, b, distance) of unequal ``s`` within reach, both ways.  ``known_exact``
    (f, name) and ``known_near`` (s, distance, name): what was accepted before all rows,
    the best match of each value.  A row repeats the accepted one of its ``f``, or else the
    closest in reach, of equal ones that with the smallest name.  Null values match
    nothing.  Accepted values in reach of one value lie more than the reach apart, so the
    options of a value are few however large its group.  Groups of at least a thousandth of
    all rows are spread by hand.
    """
    told = nodes
    if known_exact is not None:
        told = told.join(known_exact.select("f", F.col("name").alias("old_exact")), "f", "left")
    if known_near is not None:
        told = told.join(known_near.select("s", F.struct("distance", F.col("name").alias("other")).alias("old_near")), "s", "left")
    for c, kind in (("old_exact", nodes.schema["name"].dataType.simpleString()), ("old_near", None)):
        if c not in told.columns:
            told = told.withColumn(c, F.lit(None).cast(kind or f"struct<distance:int,other:{nodes.schema['name'].dataType.simpleString()}>"))
    told = cut(told)
    taken = settle(told.where("old_exact is null and old_near is null").select("f", "s", "rank", "name"), pairs)
    holder = taken.where("s is not null").select(F.col("s").alias("b"), F.struct(F.col("rank").alias("at"), F.col("name").alias("other")).alias("who"))
    options = holder.select(F.col("b").alias("s"), F.lit(0).alias("distance"), "who").unionByName(pairs.join(holder, "b").select(F.col("a").alias("s"), F.col("distance").cast("int"), "who"))
    listed = options.groupBy("s").agg(F.collect_list(F.struct("distance", F.col("who.other").alias("other"), F.col("who.at").alias("at"))).alias("options"))
    same = taken.where("f is not null").select("f", F.struct(F.col("rank").alias("at"), F.col("name").alias("other")).alias("new_exact"))
    reach = told.join(listed, "s", "left").join(same, "f", "left").select("f", "s", "old_exact", "old_near", "options", "new_exact")
    heavy = heavy_keys(nodes, ["f", "s"], least=1_000)
    joined = salted_join(rows, reach, ["f", "s"], heavy, F.col("id"))
    earlier = F.filter("options", lambda o: o["at"] < F.col("rank"))
    near = F.array_min(F.transform(earlier, lambda o: F.struct(o["distance"].alias("distance"), o["other"].alias("other"))))
    best = F.least("old_near", near)
    exact = F.coalesce("old_exact", F.when(F.col("new_exact.at") < F.col("rank"), F.col("new_exact.other")))
    return joined.select(
        "id", "name", "f", "s", "rank", exact.isNotNull().alias("exact"), F.when(exact.isNotNull(), 0).otherwise(best["distance"]).alias("distance"), F.coalesce(exact, best["other"]).alias("other")
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, distance) and the same turned round."""
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


def greedy(records: DataFrame, id_col: str, order: list[str], fingerprint: str, simhash: str, most: int = MAX_DISTANCE, register: str = "accepted", name: str | None = None) -> DataFrame:
    """(id, status, reason, duplicate_of, hamming_distance) of records considered in order.

    A record is accepted unless an earlier accepted one has its fingerprint (an exact
    duplicate, distance 0) or lies within ``most`` bits (a near duplicate of the closest,
    then of the smallest ``name``, a unique column, by default the id; ``duplicate_of`` is
    that name).  ``register``: whether a fingerprint counts as known once ``accepted``, or
    as soon as ``seen``, in which case every later copy of any record is an exact duplicate
    of the first.  ``order`` must be unique.  Null fingerprints match nothing; a record of
    null simhash is still an exact duplicate of its fingerprint's first.
    """
    if register not in ("accepted", "seen"):
        raise ValueError("register is accepted or seen")
    rows = cut(records.select(F.col(id_col).alias("id"), F.col(name or id_col).alias("name"), F.struct(*order).alias("rank"), F.col(fingerprint).alias("f"), F.col(simhash).alias("s")))
    nodes = cut(nodes_of(rows))
    pairs = cut(both_ways(near_values(nodes, "s", most)))
    decided = decide_in_order(rows, nodes, pairs)
    if register == "seen":
        first = rows.where("f is not null").groupBy("f").agg(F.min(F.struct("rank", "name")).alias("first"))
        again = F.col("first.rank") < F.col("rank")
        decided = spread_join(decided, first, ["f"], F.col("id"), rows.count()).withColumns(
            {"exact": F.coalesce(again, F.lit(False)) | F.col("exact"), "distance": F.when(again, 0).otherwise(F.col("distance")), "other": F.when(again, F.col("first.name")).otherwise(F.col("other"))}
        )
    return verdicts(decided, id_col)


def verdicts(decided: DataFrame, id_col: str) -> DataFrame:
    """(id, status, reason, duplicate_of, hamming_distance) of :func:`decide_in_order`."""
    return decided.select(
        F.col("id").alias(id_col), F.when(F.col("other").isNull(), "accept").otherwise("exclude").alias("status"),
        F.when(F.col("other").isNotNull(), F.when(F.col("exact"), "cross_source_exact_duplicate").otherwise("cross_source_near_duplicate")).alias("reason"),
        F.col("other").alias("duplicate_of"), F.when(F.col("other").isNotNull(), F.col("distance")).alias("hamming_distance"),
    )
