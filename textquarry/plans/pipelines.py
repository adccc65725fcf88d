"""End-to-end plans: manifest over all sources, shard materialisation, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.joins import spread_join
from textquarry.functions.keys import key, strip
from textquarry.functions.sampling import partition_of, ppm_selected
from textquarry.functions.state import cut
from textquarry.functions.text import content_sha256, dedup_fingerprint, simhash64, source_group_id, to_hex
from textquarry.operators.dedup import MAX_DISTANCE, greedy, priority
from textquarry.operators.registry import PARTITIONS, VISIBLE, all_violations, require, unique, violation
from textquarry.operators.screening import screen, status
from textquarry.operators.technical import TECHNICAL, classify, primary_category


def undecidable(candidates: DataFrame, id_col: str) -> DataFrame:
    """Candidates that :func:`decide` can't take: no text, or an unknown or blocked partition or lane."""
    p, lane = priority("partition", "rights_lane")
    return all_violations([
        violation(candidates, "no_text", id_col, F.col("text").isNull()),
        violation(candidates, "partition", id_col, p.isNull(), F.col("partition")),
        violation(candidates, "rights_lane", id_col, lane.isNull(), F.col("rights_lane")),
    ])


def decide(
    candidates: DataFrame, id_col: str, tokens: Column, fingerprint: Column | None = None, simhash: Column | None = None,
    domain: Column | None = None, name: str | None = None, strict: bool = False,
) -> DataFrame:
    """Decision of every candidate, in order of partition, lane, source, artifact and id.

    ``domain``: whether a candidate's source is declared as one of the domain; ``name``:
    the unique column that ``duplicate_of`` gives and that decides between equally close
    records, by default the id.  Rows that :func:`undecidable` names take no part;
    ``strict`` makes them, a repeated name, and rows without tokens or of a language that
    has no category an error.
    Accepted rows carry their category and tokens, others null and 0.  Texts stay out of
    the joins: they are read once for fingerprint, simhash, category and tokens.
    """
    if strict:
        require(undecidable(candidates, id_col).unionByName(unique(candidates, name or id_col)), "candidates")
    p, lane = priority("partition", "rights_lane")
    facts = cut(
        candidates.select(
            id_col, *([name] if name and name != id_col else []), "source_id", "artifact_id", "language", "partition", "rights_lane", p.alias("p"), lane.alias("l"),
            (fingerprint if fingerprint is not None else dedup_fingerprint("text")).alias("f"),
            (simhash if simhash is not None else simhash64("text")).alias("s"),
            primary_category(classify("text")["category"] == TECHNICAL, "language", domain).alias("category"),
            tokens.cast("bigint").alias("tokens"),
        ).where(F.col("p").isNotNull() & F.col("l").isNotNull() & F.col("f").isNotNull())
    )
    if strict:
        require(violation(facts, "no_tokens", id_col, ~(F.col("tokens") > 0)).unionByName(violation(facts, "no_category", id_col, F.col("category").isNull(), F.col("language"))), "candidates")
    verdict = greedy(facts, id_col, ["p", "l", "source_id", "artifact_id", id_col], "f", "s", name=name)
    accepted = F.col("status") == "accept"
    return facts.drop("p", "l", "f", "s").join(verdict, id_col).withColumns(
        {"primary_category": F.when(accepted, F.col("category")), "token_count": F.when(accepted, F.col("tokens")).otherwise(F.lit(0).cast("bigint"))}
    ).drop("category", "tokens")


def materialise(rows: DataFrame, id_col: str, source: Column, seed: str, parts_per_million: int, url: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Status, partition and duplicates of one shard's rows, in id order; ``tokens``: the token count, by default of bytes.

    Sample, then group and partition, screening, exact duplicates over all statuses (a
    quarantined first copy uses up its fingerprint), near duplicates among accepted rows.
    """
    record = F.trim(F.col(id_col).cast("string"))
    sampled = rows.where((F.length(record) > 0) & ppm_selected(seed, record, parts_per_million) & F.col("text").isNotNull())
    group = source_group_id(url if url is not None else F.lit(""), record)
    facts = cut(
        sampled.select(
            F.col(id_col), source.alias("source_id"), group.alias("source_group_id"), partition_of(source, group).alias("partition"),
            screen("text").alias("q"), content_sha256("text").alias("content_sha256"), dedup_fingerprint("text").alias("f"), simhash64("text").alias("s"),
            (F.octet_length("text") if tokens is None else tokens).cast("bigint").alias("tokens"),
        )
    )
    facts = facts.withColumn("screened", status("q.disposition"))
    first = facts.groupBy("f").agg(F.min(id_col).alias("first"))
    copies = spread_join(facts, first, ["f"], F.col(id_col), facts.count()).withColumn("copy", F.col(id_col) != F.col("first"))
    clean = copies.where("not copy and screened = 'accept'")
    near = greedy(clean, id_col, [id_col], "f", "s", register="seen").select(id_col, F.col("status").alias("near"), F.col("duplicate_of").alias("near_of"), "hamming_distance")
    return copies.join(near, id_col, "left").select(
        id_col, "source_id", "source_group_id", "partition", "content_sha256", F.col("f").alias("dedup_fingerprint"), F.col("q.findings.code").alias("findings"), F.col("q.utf8_bytes").alias("utf8_bytes"), "tokens",
        F.when(F.col("copy"), "exact_duplicate").when(F.col("near") == "exclude", "near_duplicate").otherwise(F.col("screened")).alias("status"),
        F.when(F.col("copy"), F.col("first")).otherwise(F.col("near_of")).alias("duplicate_of"), "hamming_distance",
    )


def calibrate(rows: DataFrame, id_col: str) -> DataFrame:
    """Counters of a shard: statuses before deduplication, exact and near duplicates beside them, these also by distance."""
    facts = cut(rows.where("text is not null").select(id_col, screen("text").alias("q"), dedup_fingerprint("text").alias("f"), simhash64("text").alias("s")))
    facts = facts.withColumn("status", status("q.disposition"))
    heads = facts.groupBy("f").agg(F.min(id_col).alias(id_col))
    clean = facts.join(heads.select(id_col), id_col, "left_semi").where("status = 'accept'")
    near = greedy(clean, id_col, [id_col], "f", "s", register="seen").where("status = 'exclude'")
    near = near.agg(F.count(F.lit(1)).alias("near_duplicates"), *[F.count_if(F.col("hamming_distance") == d).alias(f"near_at_{d}") for d in range(MAX_DISTANCE + 1)])
    totals = facts.agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("f").alias("distinct_records"), F.sum("q.utf8_bytes").alias("utf8_bytes"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accept", "quarantine", "reject")],
    )
    return totals.join(F.broadcast(near)).withColumn("exact_duplicates", F.col("records") - F.col("distinct_records"))


def ingest(candidates: DataFrame, lanes: DataFrame, ledger: DataFrame, checkpoint_lane: str) -> DataFrame:
    """Manifest entry of every ingestion candidate that a checkpoint lane may use.

    ``lanes``: (source_id, rights_lane); ``ledger``: (artifact_id, source_id) of the known
    artifacts.  Blank fields, unknown sources, lanes that the checkpoint doesn't see and
    artifacts that the ledger doesn't hold for the source are left out; :func:`refused`
    names them.
    """
    known = _with_lane(candidates, lanes, ledger, checkpoint_lane).where("problem is null")
    return known.select(
        "record_id", "language", "category", "source_id", "artifact_id", "source_group_id", "partition", F.lit(checkpoint_lane).alias("checkpoint_lane"), "source_lane",
        screen("text").alias("q"), content_sha256("text").alias("content_sha256"), dedup_fingerprint("text").alias("dedup_fingerprint"), to_hex(simhash64("text")).alias("simhash64_hex"),
    ).select(
        "record_id", "language", "category", "source_id", "artifact_id", "source_group_id", "partition", "checkpoint_lane", "source_lane", status("q.disposition").alias("status"),
        "content_sha256", "dedup_fingerprint", "simhash64_hex", "q.characters", "q.utf8_bytes", F.col("q.findings.code").alias("screening_findings"),
        (F.col("q.disposition") == "accept").alias("training_eligible"),
    )


def refused(candidates: DataFrame, lanes: DataFrame, ledger: DataFrame, checkpoint_lane: str) -> DataFrame:
    """(problem, records) of the candidates that :func:`ingest` leaves out."""
    return _with_lane(candidates, lanes, ledger, checkpoint_lane).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("records"))


def _with_lane(candidates: DataFrame, lanes: DataFrame, ledger: DataFrame, checkpoint_lane: str) -> DataFrame:
    fields = ("record_id", "text", "language", "category", "source_id", "artifact_id", "source_group_id", "partition")
    problem = F.coalesce(*[F.when(F.coalesce(F.length(strip(c)), F.lit(0)) == 0, F.lit(f"blank {c}")) for c in fields])
    named = candidates.select(*[c for c in fields if c != "source_id"], key("source_id").alias("source_id"), problem.alias("blank"))
    joined = named.join(lanes.select(F.col("source_id"), F.col("rights_lane").alias("source_lane")), "source_id", "left")
    owned = ledger.select("artifact_id", key("source_id").alias("source_id"), F.lit(True).alias("owned")).distinct()
    joined = joined.join(owned, ["artifact_id", "source_id"], "left")
    return joined.withColumn(
        "problem",
        F.coalesce(
            "blank", F.when(F.col("source_lane").isNull(), "unknown source"), F.when(~F.col("source_lane").isin(*VISIBLE[checkpoint_lane]), "lane not visible"),
            F.when(~F.col("partition").isin(*PARTITIONS), "unknown partition"), F.when(F.col("owned").isNull(), "artifact of another source"),
        ),
    )


def tokenizer_benchmark(cases: DataFrame, facts: Column, *by: str) -> DataFrame:
    """Sizes, compression against bytes and round-trip failures of a tokenizer, by the columns given.

    ``facts``: struct<tokens, unknown, exact> of the text.  Empty texts take no part.
    """
    rows = cases.where(F.length("text") > 0).select(*by, F.char_length("text").alias("c"), F.octet_length("text").alias("b"), facts.alias("f"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("c").alias("characters"), F.sum("b").alias("byte_tokens"), F.sum("f.tokens").alias("candidate_tokens"),
        F.count_if(~F.col("f.exact")).alias("roundtrip_failures"), F.sum("f.unknown").alias("unk_tokens"),
    )
    return sums.withColumns({
        "tokens_per_char": F.round(F.try_divide("candidate_tokens", "characters"), 9), "compression_vs_byte": F.round(F.try_divide("byte_tokens", "candidate_tokens"), 9),
    })
