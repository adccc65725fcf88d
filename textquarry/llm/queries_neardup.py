"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.functions.keys import WHITESPACE_CLASS
from textquarry.llm.neardup import classes, similar_rows, similar_texts
from textquarry.sources.tables import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of candidates whose texts have a likeness of at least 0.7."""
    return similar_rows(table(spark, sf, "global_candidate"), "candidate_id", "text")


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class of every candidate with a text, and how many other texts resemble its own."""
    members, pairs = similar_texts(table(spark, sf, "global_candidate"), "candidate_id", "text")
    return classes(members, pairs, "candidate_id")


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}
_PAIRS = rf"""
t AS (SELECT candidate_id, trim(regexp_replace(lower(text), '[{WHITESPACE_CLASS}]+', ' ', 'g'), ' ') AS n FROM global_candidate WHERE text IS NOT NULL),
g AS (SELECT DISTINCT candidate_id, substring(n, i, 5) AS s FROM (SELECT candidate_id, n, unnest(range(1, length(n) - 3)) AS i FROM t)),
k AS (SELECT candidate_id, count(*) AS c FROM g GROUP BY candidate_id),
j AS (SELECT a.candidate_id AS a, b.candidate_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.candidate_id < b.candidate_id GROUP BY ALL),
found AS (SELECT a, b FROM j JOIN k x ON x.candidate_id = a JOIN k y ON y.candidate_id = b WHERE common >= 0.7 * (x.c + y.c - common)
  UNION SELECT a.candidate_id, b.candidate_id FROM t a JOIN t b ON a.n = b.n AND a.candidate_id < b.candidate_id)"""
SQL = {
    "p4_found": f"WITH {_PAIRS} SELECT a AS candidate_id_a, b AS candidate_id_b FROM found",
    "p4_classes": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM found UNION SELECT b, a FROM found),
reach AS (SELECT candidate_id AS root, candidate_id AS node FROM t UNION SELECT r.root, e.b FROM reach r JOIN e ON e.a = r.node),
c AS (SELECT root AS candidate_id, min(node) AS class_id FROM reach GROUP BY root),
l AS (SELECT e.a AS candidate_id, count(DISTINCT y.n) AS links FROM e JOIN t x ON x.candidate_id = e.a JOIN t y ON y.candidate_id = e.b WHERE x.n <> y.n GROUP BY e.a)
SELECT candidate_id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (candidate_id)""",
}
