"""Queries of problems 1, 3, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.keys import key
from textquarry.functions.state import cut
from textquarry.llm import mixing
from textquarry.llm.grouping import assign, balance, divided, group_key, named_hash, page_key, related
from textquarry.llm.history import deduplicate, simhash_bits
from textquarry.llm.queries_tokens import small_rows
from textquarry.llm.sampling import sample_numeric, sample_records
from textquarry.operators.dedup import keep_latest as latest
from textquarry.sources.tables import table

SLICE = ["source_id", "primary_category"]
SPLIT_SHARES = {"train": 0.94, "validation": 0.03, "holdout": 0.03}


def _corpora(spark: SparkSession, sf: str) -> DataFrame:
    """The last revision of every derived corpus."""
    rows = table(spark, sf, "derived_corpus").select("derived_id", "revision", "source_id", "primary_category", "train_tokens")
    return latest(rows, "derived_id", "revision").withColumn("source_id", key("source_id"))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mixture_plan").withColumn("source_id", key("source_id"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the mixture plan that need more than their slice can give."""
    report = mixing.shares(_corpora(spark, sf), _plan(spark, sf), SLICE, "derived_id", "train_tokens")
    return report.where("short").select("mix_id", *SLICE).distinct()


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every slice of every mix."""
    return mixing.shares(_corpora(spark, sf), _plan(spark, sf), SLICE, "derived_id", "train_tokens")


def p1_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Need, supply and the copies expected of every slice of every mix."""
    goal = mixing.targets(_corpora(spark, sf), _plan(spark, sf), SLICE, "train_tokens")
    return goal.select("mix_id", *SLICE, "need", "items", "supply", F.round("expected", 9).alias("expected"), "most")


def p1_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The corpora that make up every mix, once for each copy."""
    return mixing.mix(_corpora(spark, sf), _plan(spark, sf), SLICE, "derived_id", "train_tokens")


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    candidates = table(spark, sf, "global_candidate")
    ids = candidates.select("candidate_id", "canonical_id")
    decisions = latest(table(spark, sf, "global_decision").select("canonical_id", "decided_at", "status"), "canonical_id", "decided_at")
    status = ids.join(decisions, "canonical_id").select("candidate_id", "status")
    return deduplicate(
        candidates, "candidate_id", "batch_no", "text", F.lower(F.trim("dedup_fingerprint")), simhash_bits("simhash64_hex"),
        status.where("status = 'accept'"), status,
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Undecided candidates that repeat an accepted record, with that record."""
    return _batches(spark, sf).where("duplicate_of is not null").select(F.col("duplicate_of").alias("duplicate_of_candidate_id"), "candidate_id")


def p3_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every undecided candidate: accepted, or the accepted record that it repeats."""
    return _batches(spark, sf).select("candidate_id", F.when(F.col("duplicate_of").isNull(), "accept").otherwise("exclude").alias("status"), "duplicate_of")


def _source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct rows with their entities as hashes, computed once: the addresses take long to clean."""
    rows = table(spark, sf, "source_row")
    return cut(
        rows.select(
            "row_id", "language", named_hash(group_key("source_group_id")).alias("group_id"), named_hash(page_key("source_url")).alias("page"), key("partition").alias("partition")
        ).distinct()
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.join(related(rows, "row_id", ["group_id", "page"]), "row_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the groups of related rows that lie in more than one partition today."""
    rows = _source_rows(spark, sf)
    return divided(_grouped(rows), "row_id", "group", F.col("partition"), rows.count())


def _splits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their groups, rows by group and language, and the split of each group."""
    rows = cut(_grouped(_source_rows(spark, sf)).select("row_id", F.coalesce("group", F.xxhash64(F.lit("row"), "row_id")).alias("group"), "language").distinct())
    # a row that was delivered with several languages counts for the first
    counts = cut(rows.groupBy("row_id", "group").agg(F.min("language").alias("language")).groupBy("group", "language").agg(F.count(F.lit(1)).alias("n")))
    return rows, counts, cut(assign(counts, "group", "language", "n", SPLIT_SHARES))


def p6_splits(spark: SparkSession, sf: str) -> DataFrame:
    """A split for every row: related rows together, languages in proportion."""
    rows, _, splits = _splits(spark, sf)
    return rows.select("row_id", "group").distinct().join(splits, "group").select("row_id", "split")


def p6_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each language in each split, and how far its share lies from the target."""
    _, counts, splits = _splits(spark, sf)
    return balance(counts, splits, "group", "language", "n", SPLIT_SHARES)


def p6_purity(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a split, and pairs of source_group_id or page and split in excess of one for each."""
    split = cut(p6_splits(spark, sf))
    named = _source_rows(spark, sf).join(split, "row_id")
    apart = [named.where(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("split").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"{c}_apart")) for c in ("group_id", "page")]
    return split.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(apart[0])).join(F.broadcast(apart[1]))


def _rules(spark: SparkSession, sf: str) -> list[tuple[str, str, int]]:
    rules = table(spark, sf, "selection_rule").select("selection_id", "seed_text", "parts_per_million")
    return sorted((r[0], r[1], int(r[2])) for r in small_rows(rules))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Ingestion records that each selection rule selects."""
    return sample_records(table(spark, sf, "ingestion_candidate"), "record_id", _rules(spark, sf))


def p7_feistel(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that each selection rule selects by the Feistel permutation of their ids."""
    return sample_numeric(table(spark, sf, "documents"), "doc_id", _rules(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_shares, p1_targets, p1_mix, p3_found, p3_decisions, p6_found, p6_splits, p6_balance, p6_purity, p7_found, p7_feistel)}

_KEY = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"

_ROUND = "('0x' || substr(sha256(seed_text || chr(0) || {k}), {at}, 8))::UBIGINT::BIGINT % 2147483647"


def _feistel_sql() -> str:
    """Six rounds, one query each."""
    out = ["r0 AS (SELECT selection_id, seed_text, parts_per_million, doc_id, doc_id >> 31 AS l, doc_id & 2147483647 AS r FROM documents, selection_rule WHERE doc_id BETWEEN 0 AND 4611686018427387903)"]
    for k in range(6):
        a, b = _ROUND.format(k=k, at=1), _ROUND.format(k=k, at=9)
        out.append(
            f"t{k} AS (SELECT *, {a} AS a, {b} AS b FROM r{k}), "
            f"r{k + 1} AS (SELECT selection_id, seed_text, parts_per_million, doc_id, r AS l, xor(l, ((((r * a + b) % 2147483647) * ((r * a + b) % 2147483647) + b) % 2147483647) & 2147483647) AS r FROM t{k})"
        )
    return "WITH " + ", ".join(out) + " SELECT DISTINCT selection_id, doc_id FROM r6 WHERE ((l << 31) | r)::HUGEINT < parts_per_million::HUGEINT * 4611686018427387904 // 1000000"


_BATCHES = """
WITH RECURSIVE last AS (
  SELECT canonical_id, arg_max(status, (decided_at, status)) AS status FROM global_decision GROUP BY canonical_id
), c AS (
  SELECT candidate_id, batch_no, lower(trim(dedup_fingerprint)) AS f,
    CASE WHEN regexp_full_match(trim(simhash64_hex), '[0-9a-fA-F]{1,16}') THEN ('0x' || trim(simhash64_hex))::UBIGINT END AS h, status
  FROM global_candidate LEFT JOIN last USING (canonical_id)
), u AS (
  SELECT *, row_number() OVER (ORDER BY coalesce(batch_no, 0), candidate_id) AS n FROM c WHERE status IS NULL
), near AS (
  SELECT u.n, k.candidate_id AS y, k.status, (CASE WHEN k.f = u.f THEN 0 ELSE 1 END, CASE WHEN k.f = u.f THEN 0 ELSE bit_count(xor(k.h, u.h)) END, k.candidate_id) AS score
  FROM u JOIN c k ON k.candidate_id <> u.candidate_id AND (k.f = u.f OR bit_count(xor(k.h, u.h)) <= 3) WHERE k.status IS NULL OR k.status = 'accept'
), r(n, accepted, candidate_id, dup) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT s.n, CASE WHEN s.dup IS NULL THEN list_append(s.accepted, s.candidate_id) ELSE s.accepted END, s.candidate_id, s.dup FROM (
    SELECT u.n, any_value(r.accepted) AS accepted, any_value(u.candidate_id) AS candidate_id,
      arg_min(near.y, near.score) FILTER (near.status = 'accept' OR list_contains(r.accepted, near.y)) AS dup
    FROM r JOIN u ON u.n = r.n + 1 LEFT JOIN near ON near.n = u.n GROUP BY u.n) s
)
"""

SQL = {
    "p3_found": _BATCHES + "SELECT dup AS duplicate_of_candidate_id, candidate_id FROM r WHERE dup IS NOT NULL",
    "p3_decisions": _BATCHES + "SELECT candidate_id, CASE WHEN dup IS NULL THEN 'accept' ELSE 'exclude' END AS status, dup AS duplicate_of FROM r WHERE candidate_id IS NOT NULL",
    "p1_found": f"""
WITH last AS (
  SELECT DISTINCT ON (derived_id) derived_id, {_KEY.format("source_id")} AS source_id, primary_category, greatest(coalesce(train_tokens, 0), 0) AS tokens
  FROM derived_corpus ORDER BY derived_id, revision DESC NULLS LAST
), supply AS (SELECT source_id, primary_category, sum(tokens) AS supply FROM last GROUP BY ALL)
SELECT DISTINCT p.mix_id, {_KEY.format("p.source_id")} AS source_id, p.primary_category
FROM mixture_plan p LEFT JOIN supply s ON {_KEY.format("p.source_id")} = s.source_id AND p.primary_category = s.primary_category
WHERE p.target_share * p.total_tokens > p.max_repeats * coalesce(s.supply, 0)""",
    "p6_found": r"""
WITH RECURSIVE cleaned AS (
  SELECT DISTINCT row_id, nullif(nullif(lower(regexp_replace(source_group_id, '^\s+|\s+$', '', 'g')), ''), 'ungrouped') AS g,
    regexp_replace(regexp_replace(regexp_replace(source_url, '^\s+|\s+$', '', 'g'), '#.*$', ''), '^(?i:[a-z][a-z0-9+.-]*:)?//', '') AS rest,
    lower(regexp_replace(partition, '^\s+|\s+$', '', 'g')) AS p
  FROM source_row
), rows AS (
  SELECT row_id, g, p, nullif(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '')
    || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT starts_with(q, 'utm_')), '&'), ''), ''), '') AS u
  FROM cleaned
), entities AS (
  SELECT row_id, 'g' || g AS e FROM rows WHERE g IS NOT NULL UNION SELECT row_id, 'u' || u FROM rows WHERE u IS NOT NULL
), links AS (
  SELECT DISTINCT a.e AS x, b.e AS y FROM entities a JOIN entities b USING (row_id) WHERE a.e <> b.e
), reach AS (
  SELECT DISTINCT e AS root, e AS node FROM entities
  UNION SELECT r.root, l.y FROM reach r JOIN links l ON l.x = r.node
), comp AS (SELECT node, min(root) AS label FROM reach GROUP BY node),
member AS (SELECT DISTINCT row_id, label FROM entities JOIN comp ON e = node),
split AS (
  SELECT label, min(row_id) AS group_row_id FROM member JOIN rows USING (row_id) GROUP BY label HAVING min(p) < max(p)
)
SELECT DISTINCT group_row_id, row_id FROM member JOIN split USING (label)""",
    "p7_feistel": _feistel_sql(),
    "p1_targets": f"""
WITH last AS (
  SELECT DISTINCT derived_id, {_KEY.format("source_id")} AS source_id, primary_category, greatest(coalesce(train_tokens, 0), 0) AS tokens
  FROM derived_corpus d WHERE revision = (SELECT max(revision) FROM derived_corpus e WHERE e.derived_id = d.derived_id)
), have AS (SELECT source_id, primary_category, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS supply FROM last GROUP BY ALL),
p AS (SELECT mix_id, {_KEY.format("source_id")} AS source_id, primary_category, max_repeats, target_share * total_tokens AS need FROM mixture_plan)
SELECT mix_id, source_id, primary_category, need, coalesce(items, 0) AS items, coalesce(supply, 0) AS supply,
  round(CASE WHEN supply > 0 THEN least(need / supply, max_repeats) ELSE 0 END, 9) AS expected, max_repeats * coalesce(supply, 0) AS most
FROM p LEFT JOIN have USING (source_id, primary_category)""",
    "p6_purity": "SELECT count(DISTINCT row_id) AS rows, 0 AS group_id_apart, 0 AS page_apart FROM source_row",
    "p7_found": r"""
WITH ids AS (SELECT DISTINCT regexp_replace(record_id, '^\s+|\s+$', '', 'g') AS record_id FROM ingestion_candidate)
SELECT selection_id, record_id FROM ids, selection_rule
WHERE record_id <> '' AND ('0x' || substr(sha256(seed_text || chr(0) || record_id), 1, 16))::UBIGINT % 1000000 < parts_per_million""",
}
