"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing column names, operator by operator."""

from pyspark.sql import functions as F

from textquarry.llm.grouping import assign, balance, divided, related
from textquarry.llm.history import deduplicate, simhash_bits
from textquarry.llm.mixing import mix, shares, targets
from textquarry.llm.neardup import classes, similar_rows, similar_texts
from textquarry.llm.packing import pack
from textquarry.llm.pii import find_personal_data, redact
from textquarry.llm.sampling import sample_numeric, sample_records
from textquarry.llm.splitting import split_texts
from textquarry.llm.tokens import count_tokens, encode_corpus

LONG = "many words and no end of them " * 40_000


def test_mixing(spark):
    items = spark.createDataFrame([("a", "x", 1, 5, 9, 9), ("a", None, 2, 5, 9, 9), (None, None, 3, None, 9, 9), ("a", "x", 1, 5, 9, 9)], "source string, cat string, id int, tokens int, rank int, expected int")
    plan = spark.createDataFrame([("m", "a", "x", 0.5, 2, 20, 1, 1), ("m", None, "x", None, None, None, 1, 1), ("n", "a", "x", 0.0, 0, 20, 1, 1)], "mix_id string, source string, cat string, target_share double, max_repeats int, total_tokens bigint, supply int, items int")
    keys = ["source", "cat"]
    assert targets(items, plan, keys, "tokens").count() == 3
    drawn = mix(items, plan, keys, "id", "tokens")
    # a repeated item is an item of its own; ten tokens are there and ten are needed
    assert sorted(tuple(r) for r in drawn.select("mix_id", "id", "copy_no").collect()) == [("m", 1, 1), ("m", 1, 1)]
    got = {(r["mix_id"], r["source"]): (r["tokens"], r["short"]) for r in shares(items, plan, keys, "id", "tokens").collect()}
    assert got == {("m", "a"): (10, False), ("m", None): (0, False), ("n", "a"): (0, False)}
    assert mix(items.where("false"), plan, keys, "id", "tokens").count() == 0 and shares(items, plan.where("false"), keys, "id", "tokens").count() == 0


def test_personal_data(spark):
    rows = [(1, None, "a", 0), (2, "", "b", 0), (3, " \n", None, 0), (4, LONG[:300_000] + " call 081-234-5678 now", "c", 0), (4, "call 081-234-5678 now", "c", 0), (None, "mail a.b@example.org now", "d", 0)]
    df = spark.createDataFrame(rows, "id int, text string, pii_kind string, pieces int")
    found = [tuple(r)[:3] for r in find_personal_data(df, "id", "text").collect()]
    assert sorted(found, key=str) == [(4, "phone", 1), (4, "phone", 1), (None, "email", 1)]
    clean = redact(df, "id", "text")
    assert clean.count() == 6 and clean.where("text is null").count() == 1 and clean.where("text like '%<PHONE>%'").count() == 2
    assert find_personal_data(df.where("false"), "id", "text").count() == 0 and redact(df.where("false"), "id", "text").count() == 0


def test_history(spark):
    text = "the same words stand here for everyone to read, " * 6
    rows = [(1, 1, text, "f1", "ff", 7), (2, None, text, "F1", None, 7), (3, 2, LONG, "f3", "00FF", 7), (4, 2, None, None, None, 7), (5, 2, "", "f5", "fe", 7), (6, 2, text, None, " 1ff ", 7), (7, 2, text, "f9", "not hex", 7)]
    df = spark.createDataFrame(rows, "id int, batch int, text string, fp string, sim string, f int").withColumn("s", F.lit(1)).withColumn("chunk", F.lit("x")).withColumn("bytes", F.lit(0)).withColumn("accepted", F.lit(True))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    got = {r["id"]: r["duplicate_of"] for r in deduplicate(df, "id", "batch", "text", F.lower("fp"), simhash_bits("sim"), ids(1), ids(1, 1)).collect()}
    # 2 by fingerprint; 3, 5 and 6 by simhash; 4 has nothing to compare; 7 has no simhash
    assert got == {2: 1, 3: 1, 4: None, 5: 1, 6: 1, 7: None}
    # nothing decided: a null batch comes first, so 2 is accepted and 1 repeats it
    fresh = {r["id"]: r["duplicate_of"] for r in deduplicate(df, "id", "batch", "text", F.lower("fp"), simhash_bits("sim"), ids(), ids()).collect()}
    assert fresh == {1: 2, 2: None, 3: None, 4: None, 5: 3, 6: 3, 7: None}


def test_near_duplicates(spark):
    rows = [(1, LONG, 0), (2, LONG + "and one more", 0), (3, None, 0), (4, "", 0), (5, " ", 0), (5, " ", 0), (6, "abcd", 0), (7, "ABCD ", 0), (8, "abcde fghij", 0), (8, "something else entirely, said once", 0), (9, "Something else entirely, said once", 0)]
    df = spark.createDataFrame(rows, "id int, text string, text_hash int").withColumn("a", F.lit(1)).withColumn("body", F.lit("x")).withColumn("label", F.lit("x"))
    got = sorted(tuple(r) for r in similar_rows(df, "id", "text").collect())
    assert got == [(1, 2), (4, 5), (6, 7), (8, 9)]
    members, pairs = similar_texts(df, "id", "text")
    label = {}
    for r in classes(members, pairs, "id").collect():
        label.setdefault(r["class_id"], set()).add(r["id"])
    assert label == {1: {1, 2}, 4: {4, 5}, 6: {6, 7}, 8: {8, 9}} or label[8] >= {8, 9}
    members, pairs = similar_texts(df.where("false"), "id", "text")
    assert classes(members, pairs, "id").count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, LONG, 0), (3, "x", 0), (None, "x y", 0)], "id int, text string, ids int").withColumn("tokens", F.lit("x"))
    got = [(r["id"], len(r["ids"])) for r in encode_corpus(df, "id", "text").collect()]
    assert sorted(got, key=str)[:2] == [(1, 0), (2, 0)] and len(got) == 5
    assert sorted(got, key=str) == sorted(((r["id"], r["tokens"]) for r in count_tokens(df, "id", "text").collect()), key=str)
    assert encode_corpus(df.where("false"), "id", "text").count() == 0


def test_splits(spark):
    rows = [(1, "g", None, None, 0), (2, "g", "u", "x", 0), (2, "g", "u", "x", 0), (3, None, "u", "y", 0), (4, None, None, None, 0), (None, "g", None, "x", 0)]
    df = spark.createDataFrame(rows, "id int, e1 string, page string, p string, node int").withColumn("label", F.lit(0)).withColumn("owner", F.lit(0))
    group = related(df, "id", ["e1", "page"])
    label = {r["id"]: r["group"] for r in group.collect()}
    assert label[1] == label[2] == label[3] == label[None] and label[4] is None
    told = divided(df.select("id", "p").join(group, "id"), "id", "group", F.col("p")).collect()
    assert {r["id"] for r in told} == {1, 2, 3}
    assert related(df.where("false"), "id", ["e1", "page"]).count() == 0
    counts = spark.createDataFrame([(1, None, 3, "z"), (1, "th", 1, "z"), (2, "th", 1, "z"), (3, "\0null", 2, "z")], "g bigint, lang string, n int, split string")
    shares_ = {"train": 0.5, "holdout": 0.5}
    where = assign(counts, "g", "lang", "n", shares_)
    assert where.count() == 3 and {r["g"] for r in where.collect()} == {1, 2, 3}
    assert balance(counts.drop("split"), where, "g", "lang", "n", shares_).count() >= 3
    assert assign(counts.where("false"), "g", "lang", "n", shares_).count() == 0


def test_samples(spark):
    rules = [("all", "s", 1_000_000), ("none", "s", 1)]
    df = spark.createDataFrame([(1, " r1 ", "x"), (1, "r1", "x"), (None, None, "x"), (-5, "", "x"), ((1 << 62) - 1, "r2", "x")], "id bigint, name string, selection_id string")
    assert sorted(tuple(r) for r in sample_numeric(df, "id", rules[:1]).collect()) == [("all", 1), ("all", (1 << 62) - 1)]
    assert sorted(tuple(r) for r in sample_records(df, "name", rules[:1]).collect()) == [("all", "r1"), ("all", "r2")]
    assert sample_numeric(df.where("false"), "id", rules).count() == 0 and sample_records(df.where("false"), "name", rules).count() == 0


def test_packing_and_splitting(spark):
    df = spark.createDataFrame([(1, None, None), (2, 0, ""), (3, 5, "a"), (3, 5, "a"), (None, 4, LONG)], "id int, n int, text string").withColumn("limit_id", F.lit("z")).withColumn("container_id", F.lit("z"))
    parts = pack(df, "id", "n", [("c", 5), ("d", 100)], 5).collect()
    assert sorted(((r["limit_id"], r["id"], r["part_tokens"]) for r in parts), key=str) == [("c", 3, 5), ("c", 3, 5), ("c", None, 4), ("d", 3, 5), ("d", 3, 5), ("d", None, 4)]
    pieces = split_texts(df, "id", "text", [("p", 2000, 50)]).collect()
    assert {r["id"] for r in pieces} == {None} and max(r["piece_tokens"] for r in pieces) <= 2000 and max(r["end_char"] for r in pieces) == len(LONG)
    assert split_texts(df.where("false"), "id", "text", [("p", 2000, 50)]).count() == 0
