import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from textquarry.operators import accounting as A
from textquarry.operators import freeze as Z
from textquarry.operators.registry import CATEGORIES, ContractError
from textquarry.operators.tokens import fit_lines, piece_ids, piece_model, piece_text
from textquarry.sources import files

GOAL = A.Mixture(thai=20, english=20, technical=5, domain=5, domain_cap=5)


def _mixture():
    thai, english, technical, domain = CATEGORIES
    return {
        "schema_version": 1, "primary_target_tokens": 50,
        "categories": {thai: {"target_tokens": 20, "minimum_tokens": 20}, english: {"target_tokens": 20, "minimum_tokens": 20}, technical: {"base_target_tokens": 5}, domain: {"target_tokens": 5, "maximum_tokens": 5}},
        "fallback_policy": {"general_language_overage_cannot_substitute_other_categories": True, "category_assignment_must_be_single_primary_category": True},
        "authorization": {"total_target_must_be_met": True, "thai_minimum_must_be_met": True, "english_minimum_must_be_met": True},
    }


def test_mixture_contract():
    assert Z.mixture_contract(_mixture(), GOAL) == []
    bad = _mixture()
    del bad["categories"][CATEGORIES[3]]
    bad["authorization"]["total_target_must_be_met"] = 1  # one is not true
    rules = Z.mixture_contract(bad, GOAL)
    assert ("categories", "categories", "another set") in rules and any(w == "authorization.total_target_must_be_met" for _, w, _ in rules)
    with pytest.raises(ContractError):
        Z.require_none(rules, "mixture")
    assert Z.mixture_contract("no object", GOAL)


def test_inventory_and_rights():
    source = {f: "x" for f in Z.SOURCE_FIELDS} | {"source_id": "s1", "categories": [CATEGORIES[0]], "languages": ["th"], "license_audit_status": "approved", "acquisition_status": "acquired"}
    inventory = {"schema_version": 1, "token_budgets": {"primary": 5}, "split": {"train": 0.99}, "target_mix": dict(zip(CATEGORIES, (0.4, 0.4, 0.1, 0.1))), "sources": [source]}
    check = lambda p: Z.inventory_contract(p, {"primary": 5}, {"train": 0.99}, ["acquired"])
    assert check(inventory) == []
    bad = copy.deepcopy(inventory)
    bad["sources"] += [source, {"source_id": "s2"}, {**source, "source_id": "s3", "license_audit_status": "maybe", "name": " "}]
    bad["target_mix"][CATEGORIES[3]] = 0.2
    bad["split"]["train"] = 0.9
    assert sorted({r for r, *_ in check(bad)}) == ["blank", "missing", "mix", "pinned", "repeated_id", "unknown_value"]
    assert check({**inventory, "sources": []})[-1][0] == "sources"
    rights = {"schema_version": 1, "total": 7, "sources": [{"source_id": "s1", "rights_lane": "release_safe"}], "promotion": [["release_safe", "research_only"]]}
    assert Z.rights_contract(rights, {"s1": "release_safe"}, {"total": 7}) == []
    rights["sources"] += [{"source_id": "s1", "rights_lane": "blocked"}, {"source_id": "s9", "rights_lane": "blocked"}]
    rights["promotion"].append(["research_only", "release_safe"])
    assert sorted({r for r, *_ in Z.rights_contract(rights, {"s1": "release_safe"}, {"total": 8})}) == ["lane", "pinned", "promotion", "repeated_id", "unknown_source"]


def _frozen(root):
    (root / "registry.json").write_text(json.dumps({"schema_version": 1, "near_duplicate_hamming_distance": 3, "pretraining_authorized": False, "inputs": [{"rights_lane": "release_safe"}]}))
    ready = {"ready": True, **dict.fromkeys(Z.GAPS, 0)}
    report = {"schema_version": 1, "decisions": {"path": "d.jsonl", "sha256": "a" * 64, "contains_raw_text": False}}
    sealed = Z.seal_report(report, str(root / "registry.json"), "registry.json", "external://ns/run", "ns", {"candidate_id": "t", "sha256": "b" * 64}, {"release_safe": ready, "research_only": {"ready": False}})
    assert sealed["pretraining_authorized"] is False and sealed["decisions"]["storage"] == "external://ns/run/d.jsonl"
    (root / "report.json").write_text(json.dumps(sealed))
    return Z.build_freeze(str(root), "registry.json", "report.json", "release_safe")


def test_freeze(tmp_path):
    freeze = _frozen(tmp_path)
    assert Z.check_freeze(freeze, str(tmp_path), "ns") == []
    with pytest.raises(ContractError):
        Z.build_freeze(str(tmp_path), "registry.json", "report.json", "research_only")
    with pytest.raises(ContractError):
        Z.build_freeze(str(tmp_path), "../registry.json", "report.json", "release_safe")
    for path, value in (
        ("optimizer_steps_completed", 1), ("pretraining_authorized", False), ("public_release_eligibility", "not_qualified"), ("checkpoint_lane", "blocked"), ("evaluation_manifest.pretraining_fit_partitions", ["train", "holdout"]),
        ("evaluation_manifest.decisions_sha256", "z"), ("tokenizer", {"candidate_id": "other"}), ("source_manifest.sha256", "c" * 64), ("source_manifest.path", "/etc/hostname"), ("evaluation_manifest.frozen", 1),
    ):
        bad = copy.deepcopy(freeze)
        *way, last = path.split(".")
        at = bad
        for w in way:
            at = at[w]
        at[last] = value
        assert Z.check_freeze(bad, str(tmp_path), "ns"), path
    # a lane that the registry's inputs don't all have
    registry = json.loads((tmp_path / "registry.json").read_text())
    registry["inputs"].append({"rights_lane": "research_only"})
    (tmp_path / "registry.json").write_text(json.dumps(registry))
    assert {r for r, *_ in Z.check_freeze(freeze, str(tmp_path), "ns")} >= {"lane", "changed_file"}


def test_locations_and_files(tmp_path):
    assert Z.location("external://ns/a/b", "ns")
    for bad in ("external://ns/", "external://ns/../x", "/tmp/x", "external://other/a", None):
        with pytest.raises(ContractError):
            Z.location(bad, "ns")
    (tmp_path / "f").write_text("body")
    sha = hashlib.sha256(b"body").hexdigest()
    got = Z.verify_files([(str(tmp_path / "f"), 4, sha), (str(tmp_path / "f"), None, "0" * 64), (str(tmp_path / "g"), 4, sha)])
    assert [r for r, *_ in got] == ["changed_file", "missing_file"]


def test_tokenizer_gate_and_fit_text(spark):
    rows = spark.createDataFrame([(10, 0, 0), (5, 1, 2)], "candidate_tokens int, roundtrip_failures int, unk_tokens int")
    assert {tuple(r) for r in Z.tokenizer_gate(rows, 31_999, 32_000).collect()} == {("vocabulary_size", "tokenizer", "31999"), ("round_trip", "tokenizer", "1"), ("unknown_tokens", "tokenizer", "2")}
    assert Z.tokenizer_gate(rows.limit(1), 32_000, 32_000).count() == 0
    texts = spark.createDataFrame([("a", "x\r\ny\rz", "train"), ("b", "v", "validation"), ("c", "h", "holdout"), ("d", None, "train")], "record_id string, text string, partition string")
    assert [tuple(r) for r in fit_lines(texts).collect()] == [("a", "x y z")]
    assert fit_lines(texts, ("train", "validation")).count() == 2
    for bad in (lambda: fit_lines(texts, ("train", "holdout")), lambda: fit_lines(texts.where("record_id = 'c'")), lambda: fit_lines(texts.unionByName(texts))):
        with pytest.raises(ContractError):
            bad()
    back = spark.createDataFrame([("Hello wide world",), ("ภาษาไทย",), (None,), ("",)], "t string").select("t", piece_text(piece_model())(piece_ids(piece_model())("t")).alias("b")).collect()
    assert [r["b"] for r in back] == ["Hello wide world", "ภาษาไทย", "", ""]


def test_counters_capacity_and_density(spark):
    rows = spark.createDataFrame([("1", "t", True), ("2", None, True), (" ", "t", True), ("3", "t", False), (None, "t", False)], "id string, text string, selected boolean")
    done = spark.createDataFrame(
        [("accept", "train", 5, ["a"], None), ("near_duplicate", "train", 4, [], 2), ("exact_duplicate", "train", 3, ["a", "b"], None), ("reject", "holdout", 2, ["b"], None)],
        "status string, partition string, tokens bigint, findings array<string>, hamming_distance int",
    )
    got = {(r["counter"], r["key"]): r["value"] for r in A.shard_counters(rows, done, "id").collect()}
    assert got[("rows_total", "")] == 5 and got[("rows_missing_id", "")] == 2 and got[("rows_missing_text", "")] == 1 and got[("rows_not_selected", "")] == 1 and got[("rows_selected", "")] == 2
    assert got[("findings", "a")] == 2 and got[("findings", "b")] == 2 and got[("near_distances", "2")] == 1 and got[("tokens_by_partition", "train")] == 5 and got[("tokens_by_status", "reject")] == 2
    base = {(r["counter"], r["key"]): r["value"] for r in A.baseline_counters(done.withColumn("utf8_bytes", F.col("tokens") * 2).where("status in ('accept', 'reject')")).collect()}
    assert base == {("input_records", ""): 2, ("accept_records", ""): 1, ("reject_records", ""): 1, ("tokens", "train"): 5, ("utf8_bytes", "train"): 10, ("findings", "a"): 1, ("findings", "b"): 1}
    lane = spark.createDataFrame([("release_safe", "general_thai", 5), ("research_only", "general_thai", 2), ("blocked", "general_thai", 9)], "lane string, category string, tokens bigint")
    cap = {(r["target_lane"], r["category"]): (r["tokens"], r["planning_only"]) for r in A.planning_capacity(lane, lane, False).collect()}
    assert cap[("release_safe", "general_thai")] == (10, True) and cap[("research_only", "general_thai")] == (14, True) and len(cap) == 8
    d = A.densities(spark.createDataFrame([(10, 20), (30, 20)], "tokens bigint, utf8_bytes bigint"), "tokens", F.lit(80)).first()
    assert d["tokens_per_stored_byte"] == 0.5 and d["tokens_per_text_byte"] == 1.0 and d["tokens_per_gib"] == 0.5 * (1 << 30)
    inventory = A.inventory(spark.createDataFrame([("th", "train", 4, 4), ("en", "train", 6, 6)], "language string, partition string, utf8_bytes bigint, tokens bigint"), "tokens", 8)
    got = {(r["grouping"], r["language"], r["partition"]): (r["tokens"], r["gap"]) for r in inventory.collect()}
    assert got[("overall", None, None)] == (10, 0) and got[("language", "th", None)] == (4, 4)


def test_rows_by_number_and_samples(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [(r["k"], r["row_number"]) for r in files.numbered(df, "k").orderBy("k").collect()] == [(i, i) for i in range(1000)]
    df.coalesce(2).write.parquet(str(tmp_path / "shard"))
    assert files.shard_in_order(spark, str(tmp_path / "shard"), "k").where("k <> row_number").count() == 0
    (tmp_path / "w" / "AA").mkdir(parents=True)
    (tmp_path / "w" / "AA" / "wiki_00").write_text("\n".join(json.dumps({"id": str(i), "url": "", "title": "t", "text": t}) for i, t in ((2, "same  text"), (1, "same text"), (3, "other"))))
    got = files.wiki_sample(spark, str(tmp_path / "w"), "release_safe").collect()
    assert {(r["record_id"], r["rights_lane"]) for r in got} == {("WIKI-1", "release_safe"), ("WIKI-3", "release_safe")}
    (tmp_path / "s.tsv").write_text("1\teng\tHello\tthere\n2\teng\tHello\tthere\n")
    pilot = files.pilot_sentences(spark, str(tmp_path / "s.tsv"), "eng", "s").collect()
    assert len(pilot) == 2 and pilot[0]["text"] == "Hello\tthere" and len({(r["dedup_fingerprint"], r["partition"]) for r in pilot}) == 1
