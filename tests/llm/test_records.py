import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions.text import simhash_of
from textquarry.llm.components import components
from textquarry.llm.grouping import assign, balance, divided, group_key, page_key, related
from textquarry.llm.history import ChunkIndex, chunk_lists, deduplicate, simhash_bits
from textquarry.llm.mixing import mix, shares, targets
from textquarry.llm.neardup import classes, similar_rows, similar_texts
from textquarry.llm.sampling import _key_array, feistel, sample_numeric, sample_records


def test_mix_reaches_shares_and_keeps_the_cap(spark):
    items = [("a", "x", i, 100) for i in range(400)] + [("b", "x", i, 10) for i in range(400, 420)] + [("a", "x", 900, None), ("a", "x", 901, -5), (None, "x", 902, 7)]
    df = spark.createDataFrame(items, "source string, cat string, id bigint, tokens bigint")
    plan = spark.createDataFrame([("m", "a", "x", 0.5, 1, 20000), ("m", "b", "x", 0.5, 3, 20000), ("m", "c", "x", 0.1, 2, 100)], "mix_id string, source string, cat string, target_share double, max_repeats int, total_tokens bigint")
    keys = ["source", "cat"]
    goal = {r["source"]: r for r in targets(df, plan, keys, "tokens").collect()}
    assert goal["a"]["most"] == 40000 and goal["b"]["most"] == 600 and goal["c"]["most"] == 0
    copies = mix(df, plan, keys, "id", "tokens").collect()
    by: dict = {}
    for r in copies:
        by.setdefault(r["id"], []).append(r["copy_no"])
    assert all(v == list(range(1, len(v) + 1)) for v in (sorted(x) for x in by.values()))
    assert all(len(by[i]) == 3 for i in range(400, 420))
    assert max(len(v) for i, v in by.items() if i < 400) == 1
    report = {r["source"]: r for r in shares(df, plan, keys, "id", "tokens").collect()}
    assert not report["a"]["short"] and report["b"]["short"] and report["c"]["short"]
    # exactly enough, and items without size, fall under the same rule
    edge = spark.createDataFrame([("e", "a", "x", 1.0, 2, 80000), ("e", "b", "x", 1.0, 4, 801), ("e", "z", "x", 1.0, 4, 1), ("e", "y", "x", 0.0, 4, 1)], plan.schema)
    more = df.unionByName(spark.createDataFrame([("z", "x", 950, 0), ("z", "x", 951, None)], df.schema))
    assert {r["source"]: r["short"] for r in shares(more, edge, keys, "id", "tokens").collect()} == {"a": False, "b": True, "z": True, "y": False}
    assert abs(report["a"]["tokens"] - 10000) <= 200 and report["b"]["tokens"] == 600 and report["c"]["copies"] == 0
    assert sorted(map(tuple, copies)) == sorted(map(tuple, mix(df.repartition(7), plan, keys, "id", "tokens").collect()))


def _hex(v):
    return None if v is None else f"{v:016x}"


def _sequential(rows, accepted, decided):
    """(id, duplicate_of) by the definition."""
    known = [r for r in rows if r[0] in accepted]
    out = {}
    for r in sorted((r for r in rows if r[0] not in decided), key=lambda r: (r[1], r[0])):
        exact = [k[0] for k in known if r[3] is not None and k[3] == r[3]]
        near = [(bin(k[4] ^ r[4]).count("1"), k[0]) for k in known if r[4] is not None and k[4] is not None]
        near = [n for n in near if n[0] <= 3]
        out[r[0]] = min(exact) if exact else min(near)[1] if near else None
        if out[r[0]] is None:
            known.append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_the_sequential_definition(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randrange(30, 90))] for _ in range(14)]
    rows = []
    for i in range(1, 161):
        b = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            b[rng.randrange(len(b))] = rng.choice(words)
        text = " ".join(b)
        s = simhash_of(text)
        for _ in range(rng.choice([0, 0, 1, 2])):
            s ^= 1 << rng.randrange(64)
        fp = f"f{hash(text) & 0xFFFFFF:x}"
        if rng.random() < 0.08:
            s = None
        if rng.random() < 0.05:
            text, fp, s = None, None, None
        rows.append((i, i // 20, text, fp, s))
    # copies of one text, all alike
    rows += [(200 + i, 9, rows[0][2] or "t", rows[0][3] or "t", rows[0][4]) for i in range(10)]
    decided = {r[0] for r in rows if r[1] < 5}
    accepted = {i for i in decided if rng.random() < 0.7}
    df = spark.createDataFrame([(i, b, t, f, _hex(s).upper() if s is not None and i % 2 else _hex(s)) for i, b, t, f, s in rows], "id bigint, batch int, text string, fp string, sim string")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id bigint")
    got = deduplicate(df, "id", "batch", "text", F.col("fp"), simhash_bits("sim"), ids(accepted), ids(decided))
    assert {r["id"]: r["duplicate_of"] for r in got.collect()} == _sequential(rows, accepted, decided)


def test_near_fingerprints_of_texts_without_a_chunk_in_common(spark):
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = []
    for k in range(60):
        s = rng.getrandbits(64)
        other = s
        for bit in rng.sample(range(64), k % 5):
            other ^= 1 << bit
        rows += [(k, 0, text(), f"f{k}", s), (100 + k, 1, text(), f"g{k}", other)]
    accepted = set(range(60))
    df = spark.createDataFrame([(i, b, t, f, _hex(s)) for i, b, t, f, s in rows], "id bigint, batch int, text string, fp string, sim string")
    ids = spark.createDataFrame([(i,) for i in accepted], "id bigint")
    got = {r["id"]: r["duplicate_of"] for r in deduplicate(df, "id", "batch", "text", F.col("fp"), simhash_bits("sim"), ids, ids).collect()}
    assert got == _sequential(rows, accepted, accepted) == {100 + k: k if k % 5 < 4 else None for k in range(60)}


def test_empty_batches(spark):
    df = spark.createDataFrame([], "id bigint, batch int, text string, fp string, sim string")
    assert deduplicate(df, "id", "batch", "text", F.col("fp"), simhash_bits("sim"), df.select("id"), df.select("id")).count() == 0


def _like(a, b):
    n = lambda t: " ".join(t.lower().split())
    x, y = n(a), n(b)
    if x == y:
        return 1.0
    g, h = ({s[i : i + 5] for i in range(len(s) - 4)} for s in (x, y))
    return len(g & h) / max(1, len(g | h))


def test_similar_rows_against_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdefgh ijklmnกขคงจ"
    bases = ["".join(rng.choice(letters) for _ in range(400)) for _ in range(12)]
    texts = []
    for _ in range(90):
        b = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 16)):
            b[rng.randrange(len(b))] = rng.choice(letters)
        texts.append("".join(b))
    texts += [texts[0], texts[0].upper(), "  " + texts[1].replace(" ", " 　"), "", "", "abc", "ABC ", "abcd", None, "ab", bases[0] + bases[1]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id bigint, text string, a int")
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] is not None and texts[j] is not None and _like(texts[i], texts[j]) >= 0.7}
    far = {p for p in want if _like(texts[p[0]], texts[p[1]]) < 0.8}
    got = {tuple(r) for r in similar_rows(df, "id", "text").collect()}
    assert got <= want and want - far <= got and len(want - got) <= max(2, len(far) // 8)
    # hot keys are split, not dropped
    assert {tuple(r) for r in similar_rows(df, "id", "text", bucket=1).collect()} == got
    members, pairs = similar_texts(df, "id", "text")
    label = {r["id"]: r["class_id"] for r in classes(members, pairs, "id").collect()}
    assert len(label) == len(texts) - 1 and all(label[i] == label[j] for i, j in got)
    assert similar_rows(df.where("id < 0"), "id", "text").count() == 0


def test_large_groups_of_copies_come_out_as_a_star(spark):
    base = "a text that many records repeat word for word, and one record nearly so"
    rows = [(i, base) for i in range(40)] + [(50, base + "!"), (51, base + "?"), (60, "another text altogether, with nothing in common"), (60, "another text altogether, with nothing in common")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    every = {tuple(r) for r in similar_rows(df, "id", "text").collect()}
    assert len(every) == 40 * 39 // 2 + 2 * 40 + 1
    star = {tuple(r) for r in similar_rows(df, "id", "text", copies=10).collect()}
    assert star == {(0, i) for i in range(1, 40)} | {(0, 50), (0, 51), (50, 51)}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 150))
    assert got[200] == 200 and got[301] == 300
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_with_spread_hubs(spark, monkeypatch):
    from textquarry.llm import components as C

    monkeypatch.setattr(C, "heavy_bound", lambda rows: 20)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 200)] + [(500, i) for i in range(400, 480)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 200)) and all(got[i] == 400 for i in [*range(400, 480), 500])


def test_pages_and_groups(spark):
    same = ["https://www.A.example/p/?utm_source=x&id=1#top", " http://a.EXAMPLE/p?id=1", "//a.example/p?id=1&utm_term=3"]
    other = ["https://a.example/P?id=1", "https://a.example/p?id=2", "https://a.example/p", "https://b.example/p?id=1"]
    rows = spark.createDataFrame([(u,) for u in [*same, *other, None, "  "]], "u string").select(page_key("u").alias("k")).collect()
    keys = [r["k"] for r in rows]
    assert len(set(keys[:3])) == 1 and len(set(keys[:7])) == 5 and keys[7] is None and keys[8] is None
    g = spark.createDataFrame([(x,) for x in (" Ab ", "ab", "UNGROUPED", " ", None)], "g string").select(group_key("g").alias("k")).collect()
    assert [r["k"] for r in g] == ["ab", "ab", None, None, None]


def test_related_rows_stay_together(spark):
    rows = [(1, "g1", None, "train"), (2, "g1", "u1", "train"), (3, "g2", "u1", "holdout"), (4, "g2", None, None), (5, None, "u2", "train"), (6, None, "u2", "train"), (7, None, None, "holdout"), (8, "g3", "u3", "train"), (9, None, "u3", "validation"), (9, None, "u3", "validation")]
    df = spark.createDataFrame(rows, "id bigint, g string, u string, p string")
    group = related(df, "id", ["g", "u"])
    label = {r["id"]: r["group"] for r in group.collect()}
    assert len({label[i] for i in (1, 2, 3, 4)}) == 1 and label[5] == label[6] and label[8] == label[9] and label[7] is None
    got = {tuple(r) for r in divided(df.join(group, "id"), "id", "group", F.col("p")).collect()}
    assert got == {(1, i) for i in (1, 2, 3, 4)} | {(8, 8), (8, 9)}


def test_assigned_splits_keep_proportions(spark):
    rng = random.Random(8)
    shares = {"train": 0.8, "validation": 0.1, "holdout": 0.1}
    rows = []
    for i in range(4000):
        # mixed groups: the main label tells nothing about the rest
        for lang in rng.sample(["th", "en", "mixed", None], rng.choice([1, 1, 2, 3])):
            rows.append((i, lang, rng.choice([1, 1, 1, 2, 5])))
    rows += [(9000, "th", 900), (9000, "en", 300), (9001, "en", 700), (9002, "th", 150), (9002, None, 400)]
    df = spark.createDataFrame(rows, "group bigint, language string, n int")
    splits = assign(df, "group", "language", "n", shares)
    got = {r["group"]: r["split"] for r in splits.collect()}
    assert len(got) == len({g for g, _, _ in rows})

    def worst(where):
        out = 0
        for lang in ("th", "en", "mixed", None):
            total = sum(n for _, k, n in rows if k == lang)
            for s, want in shares.items():
                out = max(out, abs(sum(n for g, k, n in rows if k == lang and where[g] == s) / total - want))
        return out

    assert worst(got) < 0.004
    # cutting a running total of rows, which looks at no label, does far worse
    total, at, cutted = sum(n for *_, n in rows), 0, {}
    for g in sorted(got):
        cutted[g] = "train" if at < 0.8 * total else "validation" if at < 0.9 * total else "holdout"
        at += sum(n for x, _, n in rows if x == g)
    assert worst(got) < worst(cutted) / 5
    report = balance(df, splits, "group", "language", "n", shares).collect()
    assert len(report) == 12 and abs(max(abs(r["deviation"]) for r in report) - worst(got)) < 1e-9
    assert {r["group"]: r["split"] for r in assign(df.repartition(7), "group", "language", "n", shares).collect()} == got
    assert assign(df.where("n < 0"), "group", "language", "n", shares).count() == 0


def test_feistel_is_a_bijection(spark):
    n = 1 << 12
    values = [r[0] for r in spark.range(n).select(feistel("id", _key_array("seed"), half_bits=6)).collect()]
    assert sorted(values) == list(range(n)) and values != list(range(n))
    odd = spark.createDataFrame([(None,), (-1,), (1 << 62,)], "id bigint").select(feistel("id", _key_array("seed")).alias("v")).collect()
    assert all(r["v"] is None for r in odd)


def test_samples_are_stable_and_monotone(spark):
    rules = [("small", "s", 50_000), ("large", "s", 200_000)]
    first = {tuple(r) for r in sample_numeric(spark.range(4000), "id", rules).collect()}
    again = {tuple(r) for r in sample_numeric(spark.range(8000).repartition(5), "id", rules).collect()}
    assert first == {r for r in again if r[1] < 4000}
    small, large = ({i for k, i in first if k == name} for name in ("small", "large"))
    assert small < large and 120 < len(small) < 280 and 650 < len(large) < 950
    names = spark.createDataFrame([("a ",), (" a",), ("b",), ("",), (None,), ("\t",)], "id string")
    got = sample_records(names, "id", [("all", "s", 1_000_000)]).collect()
    assert sorted(tuple(r) for r in got) == [("all", "a"), ("all", "b")]


def test_a_second_batch_needs_no_text_of_the_first(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        b = rng.sample(words, 40) if i % 3 or not rows else rows[rng.randrange(len(rows))][2].split()
        if i % 2:
            b[rng.randrange(len(b))] = "changed"
        text = " ".join(b)
        rows.append((i, i // 40, text, f"f{hash(text)}", simhash_of(text)))
    frame = lambda part: spark.createDataFrame([(i, b, t, f, _hex(s)) for i, b, t, f, s in part], "id bigint, batch int, text string, fp string, sim string")
    listed = lambda part: chunk_lists(frame(part).select("id", "batch", F.col("fp").alias("f"), simhash_bits("sim").alias("s"), "text"), F.col("text"), "id", "batch", "f", "s")
    index = ChunkIndex(spark, str(tmp_path / "chunks"), "bigint", parts=4)
    got = {}
    for k in range(3):
        part = [r for r in rows if r[1] == k]
        got |= {r["id"]: r["other"] for r in index.consider(listed(part), "id", ["batch", "id"], "f", "s", f"b{k}").collect()}
    assert got == _sequential(rows, set(), set())
    # only accepted records were appended, each of their chunks once
    table = index.rows(ChunkIndex.CHUNK)
    assert {r["id"] for r in table.select("id").distinct().collect()} == {i for i, v in got.items() if v is None}
    assert table.count() == table.select("id", "key").distinct().count() and index.batches() == ["b0", "b1", "b2"]


def test_chunks_move_only_where_the_text_does(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    df = spark.createDataFrame([(1, text), (2, text[:2000] + "inserted" + text[2000:]), (3, None), (4, ""), (5, "x" * 5000)], "id int, text string")
    got = {r["id"]: r for r in chunk_lists(df, F.col("text"), "id").collect()}
    assert sum(got[1]["bytes"]) == 4000 and sum(got[2]["bytes"]) == 4008 and sum(got[5]["bytes"]) == 5000 and max(got[5]["bytes"]) <= 512
    assert got[3]["chunk"] == [] and got[4]["chunk"] == []
    assert len(set(got[1]["chunk"]) - set(got[2]["chunk"])) <= 2


def test_a_text_is_as_many_bytes_for_any_number_of_parts():
    import numpy as np
    import pyarrow as pa

    from textquarry.llm.neardup import M, R, _blocks, _signed_texts, table_keys

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijk ") for _ in range(300)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["text_hash", "__text"])

    def size(parts, hot):
        out = next(_blocks(parts, M, R, np.array(hot, np.uint64))(iter([batch])))
        return sum(len(v) for c in out.columns[1:] for v in c.to_pylist()) / 400

    few, many, very = size(12, []), size(1000, []), size(100_000, [])
    assert few <= many <= very < 1_000 and very < 11 * 86
    # under a hot half key a text goes by its whole keys
    (_, values), = _signed_texts(iter([batch]), M, R)
    assert size(1000, np.sort(table_keys(values)[0].ravel())[:50]) > many


def test_hot_half_keys_change_nothing(spark, monkeypatch):
    from textquarry.llm import neardup

    rng = random.Random(6)
    head = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = [head + "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(20, 200))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    named = df.select(F.xxhash64("text").alias("text_hash"), F.col("text").alias("__text"))
    monkeypatch.setattr(neardup, "HOT_HALF", 0.05)
    assert len(neardup.hot_halves(named, 120)) > 0
    got = {tuple(r) for r in similar_rows(df, "id", "text").collect()}
    monkeypatch.setattr(neardup, "HOT_HALF", 2.0)
    assert len(neardup.hot_halves(named, 120)) == 0
    assert got == {tuple(r) for r in similar_rows(df, "id", "text").collect()} != set()
