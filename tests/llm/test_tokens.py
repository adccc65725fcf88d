import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textquarry.llm.bpe import byte_bpe_50k, chunks, text_buffer, tokenizer
from textquarry.llm.packing import pack, sum_of_squares, waste
from textquarry.llm.splitting import split_texts
from textquarry.llm.tokens import BYTES, PieceCounter, budget_by_slice, count_tokens, encode_corpus
from textquarry.operators.dedup import keep_latest as latest

ODD = [
    "it's we're 'sandbox  'S don't I'll x've' 's\n\n's  a  \n b\t\tc", "", " ", "\r\n\r\n x", None, "a" * 3000, "ab" * 900 + "xyz", "ก" * 700 + "็", "\x00� é 😀😀",
    "12'3 'd'", "<|endoftext|> a", "ไทย๑๒๓ 'mก", " 　 y\x1c\x1cz\x85",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe_50k())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_public_library(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(ODD + ODD)]
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i] == reference(t)


def test_random_texts(reference):
    import pyarrow as pa

    rng = random.Random(3)
    pool = "ab c'dst \n\n\t.,;1ñกขา็é😀 '"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)]
    data, off = text_buffer(pa.array(texts))
    bpe = tokenizer(byte_bpe_50k())
    counter = PieceCounter(bpe)
    for a, b in chunks(off, 700):
        e = bpe.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
        n = counter.counts(data[off[a] : off[b]], off[a : b + 1] - off[a])
        for i in range(b - a):
            want = reference(texts[a + i])
            assert e.ids[e.offsets[i] : e.offsets[i + 1]].tolist() == want
            assert n[i] == len(want)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_texts(reference, texts):
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    data, off = text_buffer(pa.array(texts, pa.string()))
    bpe = tokenizer(byte_bpe_50k())
    e = bpe.encode(data, off)
    want = [reference(t) for t in texts]
    assert [e.ids[a:b].tolist() for a, b in zip(e.offsets[:-1], e.offsets[1:])] == want
    assert PieceCounter(bpe).counts(data, off).tolist() == [len(w) for w in want]


def test_counts_and_empty_tables(spark, reference):
    df = spark.createDataFrame(list(enumerate(ODD)), "id bigint, text string")
    assert {r["id"]: r["tokens"] for r in count_tokens(df, "id", "text").collect()} == {i: len(reference(t)) for i, t in enumerate(ODD)}
    assert {r["id"]: r["tokens"] for r in count_tokens(df, "id", "text", BYTES).collect()} == {i: len((t or "").encode()) for i, t in enumerate(ODD)}
    none = df.where("id < 0")
    assert encode_corpus(none, "id", "text").count() == 0
    assert budget_by_slice(count_tokens(none, "id", "text"), "id").count() == 0


def test_latest_counts_repeats_once(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), ("b", None, None)]
    got = latest(spark.createDataFrame(rows, "k string, at int, v string"), "k", "at").collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("a", "y"), ("b", "z")]


def test_sum_of_squares_places_everything():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 101, 4000))[::-1]
    box = sum_of_squares(sizes, 100)
    used = np.bincount(box, weights=sizes)
    assert used.max() <= 100 and used.min() > 0
    assert len(used) <= np.ceil(sizes.sum() / 100) * 1.03


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 3, 50, 99, 100, 101, 250, 1000])) for i in range(500)] + [(7, 50)]
    df = spark.createDataFrame(rows, "id bigint, n bigint")
    limits = [("a", 100), ("b", 64)]
    got = pack(df, "id", "n", limits, 501, group_items=100)
    parts = got.collect()
    for name, cap in limits:
        mine = [r for r in parts if r["limit_id"] == name]
        total: dict = {}
        for r in mine:
            total[r["container_id"]] = total.get(r["container_id"], 0) + r["part_tokens"]
        assert max(total.values()) <= cap
        by_doc: dict = {}
        for r in mine:
            by_doc.setdefault(r["id"], []).append(r)
        want: dict = {}
        for i, n in rows:
            if n:
                want[i] = want.get(i, 0) + n
        assert {i: sum(r["part_tokens"] for r in v) for i, v in by_doc.items()} == want
        for i, v in by_doc.items():
            if i != 7 and want[i] <= cap:
                assert len(v) == 1
    assert all(r["unused_share"] < 0.35 for r in waste(got, limits).collect())
    assert pack(df.where("id < 0"), "id", "n", limits, 0).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "n", [("x", 0)], 1)


def test_pieces_are_the_text_again(spark, reference):
    rng = random.Random(5)
    words = ["alpha", "beta,", "gamma.", "delta\n", "eps\n\n", "ภาษาไทยที่ไม่มีช่องว่าง", "x" * 40, "12345", "don't"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 600))) for _ in range(25)]
    texts += ["ก" * 4000, "qz" * 3000, "กำ" * 900, "a b", "", None, "   " * 700, "😀" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    limits = [("p", 64, 16), ("q", 50, 0)]
    rows = split_texts(df, "id", "text", limits).collect()
    for name, cap, overlap in limits:
        for i, t in enumerate(texts):
            mine = sorted((r for r in rows if r["limit_id"] == name and r["id"] == i), key=lambda r: r["piece_no"])
            if t is None or len(reference(t)) <= cap:
                assert not mine
                continue
            assert [r["piece_no"] for r in mine] == list(range(1, mine[0]["pieces"] + 1))
            at = 0
            for r in mine:
                assert r["piece_text"] == t[r["start_char"] : r["end_char"]]
                assert r["start_char"] <= at < r["end_char"]
                assert len(reference(r["piece_text"])) <= cap
                if r["piece_no"] > 1:
                    assert r["overlap_tokens"] >= overlap
                at = r["end_char"]
            assert at == len(t)


def test_pieces_end_at_paragraphs(spark):
    text = "\n\n".join("word " * 40 + "end." for _ in range(6))
    rows = split_texts(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", [("p", 100, 0)]).collect()
    ends = [text[r["end_char"] : r["end_char"] + 2] for r in rows[:-1]]
    assert ends.count("\n\n") >= len(ends) - 1
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", [("p", 10, 10)])


def test_every_document_of_a_table(spark, reference):
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    docs = spark.read.parquet(path)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in encode_corpus(docs, "doc_id", "text").collect()} == {i: reference(t) for i, t in texts.items()}


def test_texts_that_collide_under_a_hash_by_powers_of_two(reference):
    import pyarrow as pa

    # words of Thue and Morse: alike under every polynomial modulo a power of two
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    bpe = tokenizer(byte_bpe_50k())
    for n in (1024, 2048, 4096):
        data, off = text_buffer(pa.array([a[:n], b[:n]]))
        e = bpe.encode(data, off)
        got = [e.ids[x:y].tolist() for x, y in zip(e.offsets[:-1], e.offsets[1:])]
        assert got == [reference(a[:n]), reference(b[:n])]
        assert PieceCounter(bpe).counts(data, off).tolist() == [len(g) for g in got]


@pytest.mark.parametrize("seed", range(6))
def test_no_piece_is_over_any_limit(reference, seed):
    import pyarrow as pa

    from textquarry.llm.splitting import _lay_out, _plan

    rng = random.Random(seed)
    bpe = tokenizer(byte_bpe_50k())
    pool = ["a", "b ", "the ", "word", ". ", "\n", "\n\n", "ก", "ำ", "็", "ไทย", "é", "1234", "  ", "'s", "x" * 9, "(y)", "中", "ß"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.choice([5, 60, 400]))) for _ in range(10)]
    data, off = text_buffer(pa.array(texts))
    lay = _lay_out(bpe, data, off)
    for cap in (4, 5, 7, 10, 16, 24, 33, 64, 128, 512):
        for overlap in sorted({0, 1, cap // 4, cap // 2, cap - 3, cap - 2, cap - 1}):
            text, begin, end, count = _plan(bpe, data, lay, cap, overlap)
            for i, t in enumerate(texts):
                mine = np.flatnonzero(text == i)
                ids = reference(t)
                if len(ids) <= cap:
                    assert not len(mine)
                    continue
                at = int(off[i])
                for k in mine:
                    x, y = int(lay.byte_of[begin[k]]), int(lay.byte_of[end[k]])
                    body = data[x:y].tobytes().decode()
                    assert x <= at < y and len(reference(body)) == count[k] <= cap, (cap, overlap, body)
                    at = y
                assert at == off[i + 1]
