"""Connected components by iterative minimum-label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.joins import heavy_bound, salted_join
from textquarry.functions.state import cut

#: A graph of n nodes needs about 2 log2(n) rounds; this is far beyond any table.
MOST_ROUNDS = 200


def _handed(edges: DataFrame, least: DataFrame, bound: float, spread: bool) -> DataFrame:
    """Edges (u, v) with the minimum m of their u; ``spread``: nodes of ``bound`` edges, like the root of a giant component, are divided."""
    if not spread:
        return edges.join(least.select("u", "m"), "u")
    return salted_join(edges, least.select("u", "m"), ["u"], least.where(F.col("n") >= bound).select("u"), F.col("v"))


def _degree(edges: DataFrame) -> int:
    """Edges of the node that has most, on one side."""
    sides = [edges.groupBy(F.col(c).alias("x")).agg(F.count(F.lit(1)).alias("n")) for c in ("u", "v")]
    return sides[0].unionByName(sides[1]).agg(F.max("n").alias("n")).first()["n"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the undirected edges (a, b); label is the smallest node of the component.

    Every round each node hands its smallest neighbour to its larger neighbours (large
    star) and then to its smaller ones (small star), which halves long chains; rounds end
    when no edge changes.  Nodes of high degree are aggregated by partial minima, never
    collected, and spread over several tasks where they are joined.  Loops and repeated edges are allowed, nulls are not.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    number = now.count()
    for _ in range(MOST_ROUNDS):
        bound = heavy_bound(2 * number)
        spread = number >= bound and 2 * _degree(now) >= bound
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _handed(both, least, bound, spread).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = large.unionByName(least.where("u > m").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _handed(star, low, bound, spread).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        then = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        counts = then.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("u")).first()
        forest, number = counts["n"] == counts["u"], counts["n"]
        now, before = then, now
        if forest and then.join(then.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("label propagation did not converge")
    roots = now.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    single = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("u"), F.col("a").alias("v")).distinct()
    return now.unionByName(roots).unionByName(single).groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
