"""Contracts between registries: artifacts, candidates, calibration sets, derived corpora, inputs.

Every check is a broadcast-sized lookup into a registry with a missing key as a finding;
the result is a frame of violations (rule, id, detail), empty when the contract holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import sha256_valid
from textquarry.operators.dedup import MAX_DISTANCE
from textquarry.operators.registry import VISIBLE, all_violations, lane_mismatches, require, required, unique, unknown_sources, violation

#: Redistribution terms that a blocked source may have.
BLOCKED_TERMS = ("not_qualified", "internal_only")


def _positive(df: DataFrame, id_col: str, column: str) -> DataFrame:
    return violation(df, "not_positive", id_col, ~(F.col(column) > 0), F.lit(column))


def _sha(df: DataFrame, id_col: str, column: str) -> DataFrame:
    return violation(df, "bad_sha256", id_col, ~sha256_valid(F.lower(column)), F.lit(column))


def ledger(artifacts: DataFrame, rights: DataFrame) -> DataFrame:
    """Artifacts against rights: artifact_id, source_id, rights_lane, redistribution, immutable, bytes, sha256."""
    a = artifacts
    policy = rights.select("source_id", F.col("rights_lane").alias("__policy"))
    blocked = a.join(policy, "source_id").where("__policy = 'blocked'")
    lanes = lane_mismatches(a, "artifact_id", "source_id", "rights_lane", rights).where("rule = 'lane_mismatch'")
    return all_violations([
        required(a, "artifact_id", ["artifact_id", "source_id", "rights_lane"]), unique(a, "artifact_id"), unknown_sources(a, "artifact_id", "source_id", rights), lanes,
        violation(blocked, "blocked_terms", "artifact_id", ~F.col("redistribution").isin(*BLOCKED_TERMS), F.col("redistribution")),
        violation(a, "not_immutable", "artifact_id", ~F.col("immutable")), _positive(a, "artifact_id", "bytes"), _sha(a, "artifact_id", "sha256"),
    ])


def selection(chosen: DataFrame, id_col: str, known: DataFrame, checkpoint_lane: str) -> DataFrame:
    """Sources or artifacts chosen for a checkpoint: known, once each, and of a lane it may see."""
    lanes = known.select(id_col, F.col("rights_lane").alias("__lane")).distinct()
    joined = chosen.select(id_col).join(lanes, id_col, "left")
    return all_violations([
        unique(chosen, id_col),
        violation(joined.where("__lane is null"), "unknown", id_col, F.lit(True)),
        violation(joined.where("__lane is not null"), "lane_not_visible", id_col, ~F.col("__lane").isin(*VISIBLE[checkpoint_lane]), F.col("__lane")),
    ])


def source_candidates(candidates: DataFrame, rights: DataFrame) -> DataFrame:
    """Candidates: candidate_id, source_id, rights_lane, bytes, sha256, privacy_notes array<string>."""
    c = candidates
    return all_violations([
        unique(c, "candidate_id"), unknown_sources(c, "candidate_id", "source_id", rights), lane_mismatches(c, "candidate_id", "source_id", "rights_lane", rights),
        _positive(c, "candidate_id", "bytes"), _sha(c, "candidate_id", "sha256"), violation(c, "no_privacy_notes", "candidate_id", ~(F.size("privacy_notes") > 0)),
    ])


def calibration(sets: DataFrame, rights: DataFrame) -> DataFrame:
    """Calibration sets: artifact_id, source_id, never_train, never_validation, never_holdout, accepted_fraction, tokens_per_gib, accepted_rows, observed_rows."""
    s = sets
    return all_violations([
        unique(s, "artifact_id"), unknown_sources(s, "artifact_id", "source_id", rights),
        violation(s, "not_isolated", "artifact_id", ~(F.col("never_train") & F.col("never_validation") & F.col("never_holdout"))),
        violation(s, "fraction_out_of_range", "artifact_id", ~F.col("accepted_fraction").between(0, 1)), _positive(s, "artifact_id", "tokens_per_gib"),
        violation(s, "more_accepted_than_seen", "artifact_id", F.col("accepted_rows") > F.col("observed_rows")),
    ])


def calibration_rows(rows: DataFrame, id_col: str, sets: DataFrame) -> DataFrame:
    """Rows of artifacts that are calibration sets: none of them may ever enter a partition."""
    held = sets.select("artifact_id").where("artifact_id is not null").distinct()
    return violation(rows.join(held, "artifact_id", "left_semi"), "calibration_artifact", id_col, F.lit(True), F.col("artifact_id"))


def without_calibration(rows: DataFrame, id_col: str, sets: DataFrame) -> DataFrame:
    """The rows, if none is of a calibration set; else an error."""
    require(calibration_rows(rows, id_col, sets), "calibration rows in a corpus")
    return rows


def derived(corpora: DataFrame, artifacts: DataFrame, rights: DataFrame, summaries: DataFrame) -> DataFrame:
    """Derived corpora: derived_id, source_id, artifact_id, rights_lane, train/validation/holdout_tokens, accepted_records, pretraining_authorized.

    ``summaries``: derived_id, tokens, records, as counted when the corpus was made, and,
    where both sides have it, summary_sha256, the digest of the summary that is pinned.
    """
    d = corpora
    pins = []
    if "summary_sha256" in corpora.columns and "summary_sha256" in summaries.columns:
        both = d.join(summaries.select("derived_id", F.col("summary_sha256").alias("__sha")), "derived_id", "left")
        pins = [violation(both, "changed_summary", "derived_id", ~(F.lower("summary_sha256") == F.lower("__sha")), F.col("summary_sha256"))]
    own = d.join(artifacts.select("artifact_id", F.col("source_id").alias("__source"), F.col("rights_lane").alias("__lane")), "artifact_id", "left")
    counted = d.join(summaries.select("derived_id", F.col("tokens").alias("__tokens"), F.col("records").alias("__records")), "derived_id", "left")
    total = F.col("train_tokens") + F.col("validation_tokens") + F.col("holdout_tokens")
    return all_violations([
        unique(d, "derived_id"), unknown_sources(d, "derived_id", "source_id", rights),
        violation(own, "artifact_of_another_source", "derived_id", ~(F.col("__source") == F.col("source_id")), F.col("artifact_id")),
        violation(own, "lane_mismatch", "derived_id", ~(F.col("__lane") == F.col("rights_lane")), F.col("rights_lane")),
        violation(counted, "tokens_do_not_reconcile", "derived_id", ~(total == F.col("__tokens")), total), violation(counted, "records_do_not_reconcile", "derived_id", ~(F.col("accepted_records") == F.col("__records"))),
        violation(d, "authorises_itself", "derived_id", F.col("pretraining_authorized")), *pins,
    ])


#: The fields of a manifest's input.
INPUT_FIELDS = ("input_id", "source_id", "artifact_id", "rights_lane", "language", "summary_path", "summary_sha256", "accepted_storage", "accepted_bytes", "accepted_sha256")


def input_fields(inputs: DataFrame, distance: int) -> list[tuple[str, str, str]]:
    """Problems of a manifest's plan as such: fields missing or too many, another distance of near duplicates than MAX_DISTANCE."""
    have = set(inputs.columns)
    out = [("missing_field", c, "") for c in INPUT_FIELDS if c not in have] + [("unknown_field", c, "") for c in sorted(have - set(INPUT_FIELDS))]
    return out + ([] if distance == MAX_DISTANCE else [("distance", str(distance), f"not {MAX_DISTANCE}")])


def manifest_inputs(inputs: DataFrame, artifacts: DataFrame, namespace: str) -> DataFrame:
    """Inputs of a manifest: input_id, source_id, artifact_id, rights_lane, language, accepted_storage, accepted_bytes, accepted_sha256."""
    i = inputs
    own = i.join(artifacts.select("artifact_id", F.col("source_id").alias("__source"), F.col("rights_lane").alias("__lane")), "artifact_id", "left")
    return all_violations([
        unique(i, "input_id"), unique(i.select("artifact_id"), "artifact_id"),
        violation(own, "artifact_mismatch", "input_id", ~((F.col("__source") == F.col("source_id")) & (F.col("__lane") == F.col("rights_lane"))), F.col("artifact_id")),
        violation(i, "language", "input_id", ~F.col("language").isin("th", "en"), F.col("language")), _positive(i, "input_id", "accepted_bytes"), _sha(i, "input_id", "accepted_sha256"),
        violation(i, "storage", "input_id", ~F.startswith("accepted_storage", F.lit(f"external://{namespace}/")), F.col("accepted_storage")),
    ])


def rows_of_inputs(rows: DataFrame, inputs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the lane of their input, and the violations of rows that don't agree with it.

    ``rows`` name their input in input_id; source, artifact and language must be the
    input's, and a lane they bring along must be the same.
    """
    plan = inputs.select("input_id", *[F.col(c).alias(f"__{c}") for c in ("source_id", "artifact_id", "language", "rights_lane")])
    joined = rows.join(plan, "input_id", "left")
    agree: Column = F.lit(True)
    for c in ("source_id", "artifact_id", "language"):
        agree &= F.col(c) == F.col(f"__{c}")
    brought = F.col("rights_lane").isNull() | (F.col("rights_lane") == F.col("__rights_lane")) if "rights_lane" in rows.columns else F.lit(True)
    bad = violation(joined, "row_of_another_input", id_col, ~(agree & brought), F.col("input_id"))
    good = joined.where(agree & brought).withColumn("rights_lane", F.col("__rights_lane")).drop(*[c for c in joined.columns if c.startswith("__")])
    return good, bad
