import pytest

from textquarry.operators import contracts as K
from textquarry.operators.registry import ContractError

SHA = "a" * 64


def _rules(df):
    return sorted((r["rule"], r["id"]) for r in df.collect())


def _rights(spark):
    return spark.createDataFrame([("s1", "release_safe"), ("s2", "research_only"), ("s3", "blocked")], "source_id string, rights_lane string")


def test_ledger(spark):
    shape = "artifact_id string, source_id string, rights_lane string, redistribution string, immutable boolean, bytes bigint, sha256 string"
    good = [("a1", "s1", "release_safe", "allowed", True, 5, SHA), ("a2", "s3", "blocked", "internal_only", True, 5, SHA)]
    assert not _rules(K.ledger(spark.createDataFrame(good, shape), _rights(spark)))
    bad = [("b1", "s9", "release_safe", "allowed", True, 1, SHA), ("b2", "s1", "research_only", "allowed", False, 0, "xyz"), ("b3", "s3", "blocked", "allowed", None, None, None), ("b4", "s1", "release_safe", "x", True, 1, SHA), ("b4", "s1", "release_safe", "x", True, 1, SHA)]
    got = _rules(K.ledger(spark.createDataFrame(bad, shape), _rights(spark)))
    assert {("unknown_source", "b1"), ("lane_mismatch", "b2"), ("not_immutable", "b2"), ("not_positive", "b2"), ("bad_sha256", "b2"), ("blocked_terms", "b3"), ("not_immutable", "b3"), ("repeated_id", "b4")} <= set(got)
    assert not any(i == "b1" and r != "unknown_source" for r, i in got)


def test_selection(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "source_id string")
    assert not _rules(K.selection(ids("s1", "s2"), "source_id", _rights(spark), "research_only"))
    assert _rules(K.selection(ids("s1", "s2", "s3", "s8", "s1"), "source_id", _rights(spark), "release_safe")) == [("lane_not_visible", "s2"), ("lane_not_visible", "s3"), ("repeated_id", "s1"), ("unknown", "s8")]


def test_candidates_and_calibration(spark):
    c = spark.createDataFrame([("c1", "s1", "release_safe", 1, SHA, ["x"]), ("c2", "s3", "blocked", 1, SHA, [])], "candidate_id string, source_id string, rights_lane string, bytes bigint, sha256 string, privacy_notes array<string>")
    assert _rules(K.source_candidates(c, _rights(spark))) == [("blocked_source", "c2"), ("no_privacy_notes", "c2")]
    s = spark.createDataFrame([("k1", "s1", True, True, True, 0.5, 1.0, 1, 2), ("k2", "s1", True, False, True, 1.5, 0.0, 3, 2)], "artifact_id string, source_id string, never_train boolean, never_validation boolean, never_holdout boolean, accepted_fraction double, tokens_per_gib double, accepted_rows bigint, observed_rows bigint")
    assert _rules(K.calibration(s, _rights(spark))) == [("fraction_out_of_range", "k2"), ("more_accepted_than_seen", "k2"), ("not_isolated", "k2"), ("not_positive", "k2")]


def test_derived_and_inputs(spark):
    artifacts = spark.createDataFrame([("a1", "s1", "release_safe"), ("a2", "s2", "research_only")], "artifact_id string, source_id string, rights_lane string")
    shape = "derived_id string, source_id string, artifact_id string, rights_lane string, train_tokens bigint, validation_tokens bigint, holdout_tokens bigint, accepted_records bigint, pretraining_authorized boolean"
    d = spark.createDataFrame([("d1", "s1", "a1", "release_safe", 8, 1, 1, 3, False), ("d2", "s1", "a2", "release_safe", 8, 1, 1, 3, True)], shape)
    made = spark.createDataFrame([("d1", 10, 3), ("d2", 11, 3)], "derived_id string, tokens bigint, records bigint")
    assert _rules(K.derived(d, artifacts, _rights(spark), made)) == [("artifact_of_another_source", "d2"), ("authorises_itself", "d2"), ("lane_mismatch", "d2"), ("tokens_do_not_reconcile", "d2")]
    shape = "input_id string, source_id string, artifact_id string, rights_lane string, language string, accepted_storage string, accepted_bytes bigint, accepted_sha256 string"
    i = spark.createDataFrame([("i1", "s1", "a1", "release_safe", "en", "external://ns/x", 1, SHA), ("i2", "s1", "a2", "release_safe", "de", "/x", 0, SHA)], shape)
    assert _rules(K.manifest_inputs(i, artifacts, "ns")) == [("artifact_mismatch", "i2"), ("language", "i2"), ("not_positive", "i2"), ("storage", "i2")]
    rows = spark.createDataFrame([("r1", "i1", "s1", "a1", "en"), ("r2", "i1", "s2", "a1", "en"), ("r3", "i9", "s1", "a1", "en")], "record_id string, input_id string, source_id string, artifact_id string, language string")
    good, bad = K.rows_of_inputs(rows, i, "record_id")
    assert [(r["record_id"], r["rights_lane"]) for r in good.collect()] == [("r1", "release_safe")] and _rules(bad) == [("row_of_another_input", "r2"), ("row_of_another_input", "r3")]


def test_calibration_rows_never_enter(spark):
    rows = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r3", None)], "record_id string, artifact_id string")
    sets = spark.createDataFrame([("b",), (None,)], "artifact_id string")
    assert [tuple(r) for r in K.calibration_rows(rows, "record_id", sets).collect()] == [("calibration_artifact", "r2", "b")]
    with pytest.raises(ContractError):
        K.without_calibration(rows, "record_id", sets)
    assert K.without_calibration(rows.where("record_id <> 'r2'"), "record_id", sets).count() == 2


def test_fields_of_manifest_inputs(spark):
    whole = spark.createDataFrame([], ", ".join(f"{c} string" for c in K.INPUT_FIELDS))
    assert K.input_fields(whole, 3) == []
    assert [r for r, *_ in K.input_fields(whole.drop("language").selectExpr("*", "1 AS more"), 4)] == ["missing_field", "unknown_field", "distance"]


def test_pinned_summaries(spark):
    d = spark.createDataFrame([("d1", "s", "a", "release_safe", 1, 1, 1, 2, False, "A" * 64), ("d2", "s", "a", "release_safe", 1, 1, 1, 2, False, "b" * 64)], "derived_id string, source_id string, artifact_id string, rights_lane string, train_tokens int, validation_tokens int, holdout_tokens int, accepted_records int, pretraining_authorized boolean, summary_sha256 string")
    artifacts = spark.createDataFrame([("a", "s", "release_safe")], "artifact_id string, source_id string, rights_lane string")
    summaries = spark.createDataFrame([("d1", 3, 2, "a" * 64), ("d2", 3, 2, "c" * 64)], "derived_id string, tokens int, records int, summary_sha256 string")
    got = K.derived(d, artifacts, artifacts.select("source_id", "rights_lane"), summaries).collect()
    assert [(r["rule"], r["id"]) for r in got] == [("changed_summary", "d2")]
