import hashlib
import os
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textquarry.functions import text as T
from textquarry.functions.keys import key, strip
from textquarry.functions.running import running_total
from textquarry.functions.sampling import hash_mod, partition_of, ppm_selected
from textquarry.operators.tokens import byte_count, byte_ids, byte_text, next_token_pairs

TEXTS = ["Hello\r\nworld ", "", "   ", None, "é café", "a\x1cb\x85c　d e", "straße İstanbul K", "๑๒๓ ภาษาไทย", "one two three four five", "one two three four five six", "x", "😀 �"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def _values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def _each(f):
    return [None if t is None else f(t) for t in TEXTS]


def test_normal_text_and_hashes(df):
    normal = lambda t: " ".join(unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).split())
    assert _values(df, T.normal_text("text")) == _each(normal)
    assert _values(df, T.dedup_fingerprint("text")) == _each(lambda t: hashlib.sha256(normal(t).encode()).hexdigest())
    assert _values(df, T.content_sha256("text")) == _each(lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert _values(df, T.clean_text("text")) == _each(lambda t: t.replace("\r\n", "\n").replace("\r", "\n").strip())
    assert _values(df, T.utf8_bytes("text")) == _each(lambda t: len(t.encode()))
    assert _values(df, T.line_count("text")) == _each(lambda t: t.count("\n") + 1)
    assert _values(df, strip("text")) == _each(str.strip)
    assert _values(df, key("text"))[0] == "hello\r\nworld"


def _simhash(text, width=5):
    words = unicodedata.normalize("NFC", text).casefold().split()
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    votes = [0] * 64
    for p in parts:
        h = int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8, person=b"FWLLM003").digest(), "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] >= 0) if parts else 0


def test_simhash_bands_and_distance(df, spark):
    assert _values(df, T.to_hex(T.simhash64("text"))) == _each(lambda t: f"{_simhash(t):016x}")
    assert [None if v is None else len(v) for v in _values(df, T.word_shingles("text"))] == _each(lambda t: max(1, len(t.split()) - 4) if t.split() else 0)
    v = 0xF123456789ABCDEF
    h = spark.createDataFrame([(f"{v:016X}", f"{v ^ 0b111:x}")], "a string, b string").select(T.from_hex("a").alias("a"), T.from_hex("b").alias("b"))
    r = h.select(T.hamming("a", "b"), T.likely_near("a", "b"), T.likely_near("a", "b", 2), T.band_keys("a"), T.bands("a", 1), T.to_hex("a")).first()
    assert r[0] == 3 and r[1] and not r[2]
    assert r[3] == [f"{i}:{v >> 16 * i & 0xFFFF:04x}" for i in range(4)] and r[5] == f"{v:016x}"
    assert spark.range(1).select(T.from_hex(F.lit("xyz"))).first()[0] is None
    with pytest.raises(ValueError):
        T.bands("a", 5)
    with pytest.raises(ValueError):
        T.likely_near("a", "b", 65)


def _mod(n, *parts):
    return int.from_bytes(hashlib.sha256("\0".join(parts).encode()).digest()[:8], "big") % n


def test_hash_sampling(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"))
    rows = df.select("id", hash_mod(1_000_000, F.lit("s β"), "id").alias("h"), ppm_selected("s β", "id", 40_000).alias("in"), partition_of(F.lit("src"), "id", "seed").alias("p")).collect()
    for r in rows:
        assert r["h"] == _mod(1_000_000, "s β", r["id"]) and r["in"] == (r["h"] < 40_000)
        h = _mod(10_000, "seed", "src", r["id"])
        assert r["p"] == ("train" if h < 9900 else "validation" if h < 9950 else "holdout")
    odd = spark.createDataFrame([(None, "a"), ("", "a"), ("a", "")], "s string, g string").select(partition_of("s", "g"), ppm_selected("x", "s", 1_000_000)).collect()
    assert [r[0] for r in odd] == [None] * 3 and odd[0][1] is False
    with pytest.raises(ValueError):
        ppm_selected("s", "id", 0)


def test_group_ids_and_ranks(spark):
    r = spark.createDataFrame([(" http://x ", "1"), (" ", "2"), (None, "3")], "u string, r string").select(T.source_group_id("u", "r"), T.rank_hash("r"), T.canonical_id("r", "r", "r")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [x[0] for x in r] == [sha("url:http://x"), sha("id:2"), sha("id:3")]
    assert r[0][1] == sha("1") and r[0][2] == "1::1::1"


def test_byte_tokens(df):
    assert _values(df, byte_ids("text", True, True)) == _each(lambda t: [1, *(b + 4 for b in t.encode()), 2])
    assert _values(df, byte_count("text", bos=True)) == _each(lambda t: len(t.encode()) + 1)
    assert _values(df, byte_text(byte_ids("text", True, True))) == TEXTS
    pairs = _values(df, next_token_pairs(byte_ids("text"), 3))
    assert pairs[1] is None and pairs[10] is None and tuple(pairs[0]) == ([b + 4 for b in b"Hel"], [b + 4 for b in b"ell"])


def test_token_pairs_over_whole_texts(spark, df):
    def want(t):
        ids = [1, *(b + 4 for b in t.encode()), 2]
        return ids[:-1], ids[1:]

    assert [p and tuple(p) for p in _values(df, next_token_pairs(byte_ids("text", True, True)))] == _each(want)
    root = "/root/testdata/sf0.001"
    if not os.path.isdir(root):
        pytest.skip("no tables here")
    texts = {r["audit_id"]: r["text"] for r in spark.read.parquet(f"{root}/audit_row.parquet").collect() if r["text"] is not None}
    assert max(len(t.encode()) for t in texts.values()) > 16
    got = {r["audit_id"]: (r["input"], r["target"]) for r in entry.queries()["token_pairs_whole"](spark, root).collect()}
    assert got == {i: tuple(",".join(map(str, x)) for x in want(t)) for i, t in texts.items()}


def test_bad_ids_give_no_text(spark):
    got = spark.createDataFrame([([300],), ([4 + 0xC3],), ([1, 2],), (None,)], "ids array<int>").select(byte_text("ids")).collect()
    assert [r[0] for r in got] == [None, None, "", None]


def test_running_total(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("k"), F.when(F.col("id") % 10 != 0, F.col("id")).alias("w"))
    rows = running_total(df, ["k"], ["id"], F.col("w"), "before", buckets=7).collect()
    for k in (None, "0", "1"):
        mine = sorted((r for r in rows if r["k"] == k), key=lambda r: (r["before"], r["w"] or 0))
        assert sum(r["w"] or 0 for r in mine) == max(r["before"] + (r["w"] or 0) for r in mine)
        steps = sorted(((r["before"], r["before"] + (r["w"] or 0)) for r in mine if r["w"]))
        assert all(a[1] == b[0] for a, b in zip(steps, steps[1:])) and steps[0][0] == 0
