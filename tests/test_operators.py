import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import accounting as A
from textquarry.operators import registry as R
from textquarry.operators.dedup import greedy, keep_first, near_matches, near_values, settle
from textquarry.operators.index import FingerprintIndex
from textquarry.operators.screening import screen, status
from textquarry.operators.selection import balance_bytes, ppm_sample, select_bytes
from textquarry.operators.technical import TECHNICAL, classify, primary_category
from textquarry.plans.pipelines import calibrate, decide, materialise, undecidable


def _signed(v):
    return v - (1 << 64) if v >> 63 else v


def _screen(spark, *texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["s"] for r in df.orderBy("i").select(screen("text", **options).alias("s")).collect()]


def _codes(result):
    return {f["code"]: f["count"] for f in result["findings"]}


def test_screening_findings(spark):
    clean, both, card, secret, nul, runs, empty, blank, none = _screen(
        spark, "A plain sentence.", "write to a.b@example.org now, host 10.0.0.255", "card 4111 1111 1111 1111 ok", "api_key = 'ABCDEFGHIJKLMNOP1234'", "a\x00b" + "c" * 300,
        "=" * 30 + "text", "", " 　", None,
    )
    assert clean["disposition"] == "accept" and not clean["findings"]
    assert _codes(both) == {"possible_email": 1, "possible_ipv4": 1} and both["disposition"] == "review"
    assert _codes(card) == {"possible_payment_card": 1} and card["disposition"] == "reject"
    assert _codes(secret) == {"possible_secret": 1}
    assert _codes(nul)["nul_byte"] == 1 and "excess_control_characters" not in _codes(nul)
    assert _codes(runs) == {"suspicious_repeated_character_runs": 1}
    assert list(_codes(empty)) == ["too_short", "blank_or_whitespace"] and empty["control_ratio"] == 0
    assert list(_codes(blank)) == ["blank_or_whitespace"] and none is None


def test_thresholds_are_exclusive(spark):
    a, b, c, d, e, f, g = _screen(
        spark, "\x01" + "x y" * 33, "\x01\x01" + "x y" * 33, "�" + "ab " * 66 + "a", "x" * 11 + " y", "z" * 12 + "a b" * 36, "id 123456789012345678", "4012888888881882",
    )
    assert not a["findings"] and "excess_control_characters" in _codes(b)
    assert not c["findings"] and not d["findings"] and not e["findings"] and abs(e["repeated_run_ratio"] - 0.1) < 1e-12
    assert not f["findings"] and not g["findings"]
    with pytest.raises(ValueError):
        screen("text", min_characters=5, max_characters=4)


def test_email_and_digit_boundaries(spark):
    a, b, c, d = _screen(spark, "see a@b.org.", "ไa@b.org", "a@b.org, c@d.com", "๔๑๑๑ ๑๑๑๑ ๑๑๑๑ ๑๑๑๑")
    assert not a["findings"] and not b["findings"] and _codes(c) == {"possible_email": 2} and _codes(d) == {"possible_payment_card": 1}
    assert _codes(_screen(spark, "call +66 81 234 5678 now", phones=True)[0]) == {"possible_phone": 1}


def test_classifier(spark):
    texts = [
        "import os\ndef f(x):\n    return x", "A walk by the river in May.", "From here on\nLet us go", "See doi: 10.1234/abc and 5 mm and 3.2e-4", "อัลกอริทึมและแบบจำลอง", "ฐานข้อมูล",
        "the algorithm and the kernel of the database", None, "a { b } ; c { d } ; e => f :: g",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(classify("text").alias("c"))
    got = [r["c"] for r in df.collect()]
    assert got[0]["category"] == TECHNICAL and got[0]["score"] == 4 and got[0]["signals"] == ["code_keywords"]
    assert got[1]["score"] == 0 and got[2]["score"] == 4
    assert got[3]["signals"] == ["doi", "scientific_notation", "units"] and got[3]["score"] == 3
    assert got[4]["score"] == 3 + 1 and got[5]["score"] == 0 and got[7] is None
    assert got[6]["signals"] == ["technical_term_density"] and got[6]["score"] == 2
    assert got[8]["signals"] == ["code_symbol_density"] and got[8]["score"] == 1
    route = spark.createDataFrame([(True, "th"), (False, "en"), (False, "de")], "t boolean, l string").select(primary_category(F.col("t"), "l")).collect()
    assert [r[0] for r in route] == [TECHNICAL, "general_english", None]


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, None), (None, 5, "y"), (None, 4, "z"), ("b", 1, "w")], "k string, i int, v string")
    assert {(r["i"], r["v"]) for r in keep_first(df, ["k"], ["i"]).collect()} == {(1, None), (1, "w"), (4, "z")}


def _sequential(rows, most=3):
    """Decisions in order: (fingerprint, simhash) rows."""
    kept, out = [], {}
    for i, f, s in rows:
        exact = [k for k in kept if k[1] == f]
        near = sorted((bin(k[2] ^ s).count("1"), k[0]) for k in kept)
        if exact:
            out[i] = ("exclude", "cross_source_exact_duplicate", exact[0][0], 0)
        elif near and near[0][0] <= most:
            out[i] = ("exclude", "cross_source_near_duplicate", near[0][1], near[0][0])
        else:
            out[i] = ("accept", None, None, None)
            kept.append((i, f, s))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_greedy_against_the_definition(spark, seed):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(140):
        s = rng.choice(bases)
        for _ in range(rng.randrange(0, 5)):
            s ^= 1 << rng.randrange(12)
        # equal fingerprints have equal simhash
        rows.append((i, f"{s}-{rng.randrange(2)}", s))
    df = spark.createDataFrame([(i, f, _signed(s)) for i, f, s in rows], "id int, f string, s bigint")
    got = {r["id"]: (r["status"], r["reason"], r["duplicate_of"], r["hamming_distance"]) for r in greedy(df, "id", ["id"], "f", "s").collect()}
    assert got == _sequential(rows)


def test_greedy_chain_and_seen(spark):
    rows = [(1, "a", 0), (2, "b", 0b11), (3, "c", 0b1111), (4, "b", 0b11)]
    df = spark.createDataFrame(rows, "id int, f string, s bigint")
    got = {r["id"]: (r["status"], r["duplicate_of"]) for r in greedy(df, "id", ["id"], "f", "s").collect()}
    assert got == {1: ("accept", None), 2: ("exclude", 1), 3: ("accept", None), 4: ("exclude", 1)}
    seen = {r["id"]: (r["reason"], r["duplicate_of"]) for r in greedy(df, "id", ["id"], "f", "s", register="seen").collect()}
    assert seen[4] == ("cross_source_exact_duplicate", 2)
    assert greedy(df.where("id < 0"), "id", ["id"], "f", "s").count() == 0
    with pytest.raises(ValueError):
        greedy(df, "id", ["id"], "f", "s", register="never")


def test_near_values_and_matches(spark):
    rng = random.Random(5)
    v = [rng.getrandbits(64) for _ in range(30)]
    v += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in v]
    df = spark.createDataFrame([(i, _signed(x)) for i, x in enumerate(v)] + [(99, None)], "id int, s bigint")
    for most in (0, 3, 7):
        want = {frozenset((_signed(a), _signed(b))) for a in v for b in v if a < b and bin(a ^ b).count("1") <= most}
        assert {frozenset((r["a"], r["b"])) for r in near_values(df, "s", most).collect()} == want
    got = {(r["query_id"], r["match_id"], r["distance"]) for r in near_matches(df.where("id % 5 = 0"), df, "id", "s").collect()}
    assert got == {(i, j, bin(a ^ b).count("1")) for i, a in enumerate(v) for j, b in enumerate(v) if i != j and i % 5 == 0 and bin(a ^ b).count("1") <= 3}


def test_near_values_send_no_keys_to_the_driver(spark):
    # the values look small enough for a broadcast, their 120 keys each are not
    values = spark.range(3_000).select(F.xxhash64(F.col("id") % 1_500).bitwiseXOR(F.col("id")).alias("s"))
    for against in (None, values.where("s > 0")):
        near = near_values(values, "s", 7, against)
        rows = near.collect()
        assert rows
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
        # no coalesced task makes all keys
        assert "REPARTITION_BY_NUM" in plan
        assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") == r["distance"] <= 7 for r in rows)


def test_settling_a_long_chain(spark):
    n = 12
    nodes = spark.range(n).select(F.lit(None).cast("string").alias("f"), F.col("id").alias("s"), F.col("id").alias("rank"))
    one = spark.range(1, n).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    pairs = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    assert sorted(r["s"] for r in settle(nodes, pairs).collect()) == list(range(0, n, 2))


def _in_order(rows):
    """(id: (exact, distance, other)) of (id, f, s) rows in order, by the definition."""
    known, out = [], {}
    for i, f, s in rows:
        exact = [k[0] for k in known if f is not None and k[1] == f]
        near = sorted((bin(k[2] ^ s).count("1"), k[0]) for k in known if s is not None and k[2] is not None)
        near = [x for x in near if x[0] <= 3]
        out[i] = (True, 0, exact[0]) if exact else (False, *near[0]) if near else (False, None, None)
        if not exact and not near:
            known.append((i, f, s))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_batches_through_the_index_equal_one_pass(spark, tmp_path, seed):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(160):
        s = rng.choice(bases)
        for _ in range(rng.randrange(0, 5)):
            s ^= 1 << rng.randrange(14)
        # dirty rows: one fingerprint with several simhashes, nulls
        rows.append((i, None if rng.random() < 0.1 else f"f{rng.randrange(60)}", None if rng.random() < 0.1 else s))
    rows += [(200 + i, "hot", bases[0]) for i in range(60)]
    df = spark.createDataFrame([(i, f, None if s is None else _signed(s)) for i, f, s in rows], "id int, f string, s bigint")
    want = _in_order(rows)
    index = FingerprintIndex(spark, str(tmp_path / "index"), "int", parts=8)
    got = {}
    for k, (low, high) in enumerate([(0, 60), (60, 61), (61, 150), (150, 300)]):
        part = df.where((F.col("id") >= low) & (F.col("id") < high))
        got |= {r["id"]: (r["exact"], r["distance"], r["other"]) for r in index.consider(part, "id", ["id"], "f", "s", f"b{k}").collect()}
    assert got == want
    assert index.batches() == ["b0", "b1", "b2", "b3"] and index.count() == sum(v[2] is None for v in want.values())
    once = greedy(df, "id", ["id"], "f", "s").collect()
    assert {r["id"]: r["duplicate_of"] for r in once} == {i: v[2] for i, v in want.items()}


def test_index_refuses_repeated_and_blank_ids(spark, tmp_path):
    index = FingerprintIndex(spark, str(tmp_path / "index"))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, f string, s bigint")
    index.add(rows(("a", "x", 5), ("b", "y", 7)), "first")
    index.add(rows(("a", "x", 5), ("b", "y", 7)), "first")  # a batch that is written again replaces itself
    assert index.count() == 2
    for bad in (rows(("a", "z", 1)), rows(("c", "z", 1), ("c", "w", 2)), rows((" ", "z", 1))):
        with pytest.raises(R.ContractError):
            index.add(bad, "second")
    assert index.batches() == ["first"]
    found = index.find(rows(("q", "-", 4)), "id", "s").orderBy("distance", "match_id").collect()
    assert [tuple(r) for r in found] == [("q", "a", 1), ("q", "b", 2)]
    with pytest.raises(ValueError):
        index.find(rows(("q", "-", 4)), "id", "s", most=9)
    with pytest.raises(ValueError):
        index.write(rows(), "a/b")


def test_byte_budgets(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0, 5, 20, 40])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, size int")
    rank = F.sha2(F.col("id").cast("string"), 256)
    import hashlib

    order = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    want = set()
    for g in ("a", "b", None):
        total = 0
        for i, _, s in sorted((r for r in rows if r[1] == g), key=lambda r: order(r[0])):
            if total < 300:
                want.add(i)
            total += s or 0
    assert {r["id"] for r in select_bytes(df, ["g"], rank, F.col("size"), 300).collect()} == want
    with pytest.raises(ValueError):
        select_bytes(df, ["g"], rank, F.col("size"), 0)
    two = df.where("g is not null")
    totals = {r["g"]: r["t"] for r in two.groupBy("g").agg(F.sum("size").alias("t")).collect()}
    small = min(totals, key=totals.get)
    kept = balance_bytes(two, "g", rank, F.col("size"))
    after = {r["g"]: r["t"] for r in kept.groupBy("g").agg(F.sum("size").alias("t")).collect()}
    assert after[small] == totals[small] and all(totals[small] <= t < totals[small] + 40 for t in after.values())
    assert ppm_sample(df, "id", "s", 1_000_000).count() == 400


def test_registry_rules(spark):
    registry = spark.createDataFrame([("s1", "release_safe"), ("s2", "blocked")], "source_id string, rights_lane string")
    rows = spark.createDataFrame([(1, "s1", "release_safe"), (2, "s1", None), (3, "s2", "blocked"), (4, "s9", "x"), (4, "s1", "release_safe")], "id int, s string, lane string")
    broken = R.all_violations([R.unknown_sources(rows, "id", "s", registry), R.lane_mismatches(rows, "id", "s", "lane", registry), R.unique(rows, "id"), R.one_of(rows, "id", "lane", R.LANES)])
    assert sorted((r["rule"], r["id"]) for r in broken.collect()) == [("blocked_source", "3"), ("lane_mismatch", "2"), ("repeated_id", "4"), ("unknown_source", "4"), ("unknown_value", "2"), ("unknown_value", "4")]
    with pytest.raises(R.ContractError):
        R.require(broken, "rows")
    R.require(broken.where("id = 'none'"), "rows")
    assert {tuple(r) for r in R.set_difference(registry, rows.withColumnRenamed("s", "source_id"), "source_id").collect()} == {("s9", "right")}
    lanes = spark.createDataFrame([(a, b) for a in R.LANES for b in R.LANES], "a string, b string")
    assert {(r["a"], r["b"]) for r in lanes.where(R.promotable("a", "b")).collect()} == {("release_safe", "release_safe"), ("release_safe", "research_only"), ("research_only", "research_only")}


def test_readiness_and_plans(spark):
    rows = [("release_safe", "general_thai", 100), ("release_safe", "general_english", 80), ("research_only", "technical_scientific_code", 40), ("research_only", "flywire_domain", 90), ("blocked", "general_thai", 5)]
    cap = A.capacity(spark.createDataFrame(rows, "lane string, cat string, tokens bigint"), "lane", "cat", "tokens")
    assert cap.count() == 8
    got = {r["target_lane"]: r for r in A.readiness(cap, A.Mixture(100, 80, 20, 30, 30)).collect()}
    assert got["research_only"]["ready"] and got["research_only"]["domain_used"] == 30 and got["research_only"]["technical_required"] == 20
    assert not got["release_safe"]["ready"] and got["release_safe"]["technical_gap"] == 50 and got["release_safe"]["total_gap"] == 50
    plan = A.budget_plan(spark.createDataFrame([(250_000_000,), (500_000_000,), (1_000_000_000,)], "t bigint"), F.col("t"), 65_536, 0.02).orderBy("t").collect()
    assert [(r["steps"], r["warmup_steps"], r["scheduled_tokens"]) for r in plan] == [(3815, 77, 250_019_840), (7630, 153, 500_039_680), (15259, 306, 1_000_013_824)]


def test_grouping_sets_tell_nulls_from_totals(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    got = {(r["grouping"], r["k"]): r["n"] for r in A.grouping_sets(df, [[], ["k"]], [F.sum("n").alias("n")]).collect()}
    assert got == {("overall", None): 3, ("k", "a"): 1, ("k", None): 2}


def test_manifest_order_beats_arrival(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "s", "a", "en", "train", "release_safe", text), (2, "s", "a", "en", "holdout", "research_only", text), (3, "s", "a", "en", "train", "blocked", text), (4, "s", "a", "en", "odd", "release_safe", "x"), (5, "s", "a", "th", "train", "release_safe", text.upper() + " and more"), (6, "s", "a", "en", "train", "release_safe", None)]
    df = spark.createDataFrame(rows, "candidate_id int, source_id string, artifact_id string, language string, partition string, rights_lane string, text string")
    got = {r["candidate_id"]: r for r in decide(df, "candidate_id", F.octet_length("text")).collect()}
    assert set(got) == {1, 2, 5}
    assert got[2]["status"] == "accept" and got[2]["token_count"] == len(text) and got[2]["primary_category"] == "general_english"
    assert got[1]["reason"] == "cross_source_exact_duplicate" and got[1]["duplicate_of"] == 2 and got[1]["token_count"] == 0 and got[1]["primary_category"] is None
    assert sorted((r["rule"], r["id"]) for r in undecidable(df, "candidate_id").collect()) == [("no_text", "6"), ("partition", "4"), ("rights_lane", "3")]
    with pytest.raises(R.ContractError):
        decide(df, "candidate_id", F.octet_length("text"), strict=True)
    good = df.where("candidate_id in (1, 2, 5)")
    assert decide(good, "candidate_id", F.octet_length("text"), strict=True).count() == 3
    with pytest.raises(R.ContractError):
        decide(good, "candidate_id", F.lit(0), strict=True)
    with pytest.raises(R.ContractError):
        decide(good.unionByName(good), "candidate_id", F.octet_length("text"), strict=True)


def test_equally_close_records_by_name(spark):
    rows = [(1, "z", "f1", 0b0011), (2, "a", "f2", 0b11110011), (3, "m", "f3", 0b00110011)]
    df = spark.createDataFrame(rows, "id int, name string, f string, s bigint")
    got = {r["id"]: (r["status"], r["duplicate_of"], r["hamming_distance"]) for r in greedy(df, "id", ["id"], "f", "s", most=2, name="name").collect()}
    assert got == {1: ("accept", None, None), 2: ("accept", None, None), 3: ("exclude", "a", 2)}
    # a fingerprint without a simhash still matches exactly
    odd = spark.createDataFrame([(1, "f", None), (2, "f", 5), (3, "g", 5), (4, None, None)], "id int, f string, s bigint")
    assert {r["id"]: r["duplicate_of"] for r in greedy(odd, "id", ["id"], "f", "s").collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_quarantined_first_copy_uses_up_its_fingerprint(spark):
    mail = "please write to someone@example.org about the matter at hand today"
    rows = [(1, mail), (2, mail), (3, "a clean text of its own with several words in it"), (4, "A clean text of its own with several words in it"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: (r["status"], r["duplicate_of"]) for r in materialise(df, "id", F.lit("s"), "seed", 1_000_000).collect()}
    assert got == {1: ("quarantine", None), 2: ("exact_duplicate", 1), 3: ("accept", None), 4: ("near_duplicate", 3), 6: ("reject", None)}
    c = calibrate(df, "id").first()
    assert (c["records"], c["exact_duplicates"], c["near_duplicates"], c["quarantine"], c["accept"]) == (5, 1, 1, 2, 2)


def test_ingestion_and_benchmark(spark):
    from textquarry.operators.tokens import piece_facts, piece_ids, piece_model
    from textquarry.plans.pipelines import ingest, refused, tokenizer_benchmark

    row = ("r", "some text", "en", "c", " S1 ", "s1-a1", "g", "train")
    rows = [row, ("r2", " ", *row[2:]), ("r3", "x", "en", "c", "s2", "s2-a", "g", "train"), ("r4", "x", "en", "c", "s9", "s9-a", "g", "train"), ("r5", "x", "en", "c", "s1", "s3-a", "g", "train"), ("r6", "x", "en", "c", "s1", "s1-a", "g", "dev")]
    df = spark.createDataFrame(rows, "record_id string, text string, language string, category string, source_id string, artifact_id string, source_group_id string, partition string")
    lanes = spark.createDataFrame([("s1", "release_safe"), ("s2", "research_only")], "source_id string, rights_lane string")
    # an artifact belongs to the source that the ledger names, whatever its id begins with
    ledger = spark.createDataFrame([("s1-a1", "S1"), ("s2-a", "s2"), ("s9-a", "s9"), ("s3-a", "s3"), ("s1-a10", "s10")], "artifact_id string, source_id string")
    more = df.unionByName(df.limit(1).withColumn("artifact_id", F.lit("s1-a10")).withColumn("source_id", F.lit("s1")))
    assert [r["records"] for r in refused(more, lanes, ledger, "release_safe").where("problem = 'artifact of another source'").collect()] == [2]
    entry = ingest(df, lanes, ledger, "release_safe").collect()
    assert [(r["record_id"], r["status"], r["training_eligible"], r["characters"]) for r in entry] == [("r", "accept", True, 9)]
    assert {tuple(r) for r in refused(df, lanes, ledger, "release_safe").collect()} == {("blank text", 1), ("lane not visible", 1), ("unknown source", 1), ("artifact of another source", 1), ("unknown partition", 1)}
    texts = spark.createDataFrame([("a", "Hello wide world"), ("a", ""), ("a", None), ("b", "ภาษาไทย")], "language string, text string")
    got = {r["language"]: r for r in tokenizer_benchmark(texts, piece_facts(piece_model())("text"), "language").collect()}
    assert got["a"]["cases"] == 1 and got["a"]["candidate_tokens"] == 3 and got["a"]["unk_tokens"] == 0 and got["b"]["roundtrip_failures"] == 0
    assert len(texts.where("language = 'b'").select(piece_ids(piece_model())("text").alias("i")).first()["i"]) == got["b"]["candidate_tokens"]


def test_status(spark):
    got = spark.createDataFrame([("accept",), ("review",), ("reject",)], "d string").select(status("d")).collect()
    assert [r[0] for r in got] == ["accept", "quarantine", "reject"]


def test_integrity(spark):
    from textquarry.functions.text import content_sha256, dedup_fingerprint, simhash64, to_hex

    base = spark.createDataFrame([(1, "some text here"), (2, "other words")], "id int, text string")
    good = base.select(
        "id", "text", *[F.lit("x").alias(c) for c in ("record_id", "source_id", "artifact_id", "source_group_id")], F.lit("en").alias("language"), F.lit("train").alias("partition"),
        F.lit("release_safe").alias("rights_lane"), content_sha256("text").alias("content_sha256"), dedup_fingerprint("text").alias("dedup_fingerprint"), to_hex(simhash64("text")).alias("simhash64_hex"),
    )
    assert R.candidate_integrity(good, "id").count() == 0
    bad = good.withColumn("text", F.when(F.col("id") == 1, "changed").otherwise(F.col("text"))).withColumn("partition", F.lit("dev"))
    assert sorted((r["rule"], r["id"]) for r in R.candidate_integrity(bad, "id").collect()) == [("content_sha256", "1"), ("dedup_fingerprint", "1"), ("simhash64", "1"), ("unknown_value", "1"), ("unknown_value", "2")]


def test_salted_joins_equal_plain_ones(spark):
    from textquarry.functions.joins import heavy_keys, salted_join, spread_join

    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("4", 2), (None, 3), ("none", 4)], "k string, v int")
    want = {(r["id"], r["v"]) for r in left.join(right.withColumnRenamed("k", "x"), F.col("k").eqNullSafe(F.col("x")), "left").collect()}
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for heavy in (heavy_keys(counts, ["k"], least=100), counts.where("false").select("k"), counts.select("k")):
        got = salted_join(left, right, ["k"], heavy, F.col("id"))
        assert got.columns == ["id", "k", "v"] and {(r["id"], r["v"]) for r in got.collect()} == want
    assert {(r["id"], r["v"]) for r in spread_join(left, right, ["k"], F.col("id"), 5000, least=100).collect()} == want
    assert {(r["id"], r["v"]) for r in spread_join(left, right, ["k"], F.col("id"), 5000).collect()} == want
    assert heavy_keys(counts.where("false"), ["k"]).count() == 0
