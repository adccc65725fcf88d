import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, list):
        return [_plain(x) for x in v]
    f = float(v)
    return int(f) if f == int(f) else round(f, 8)


def test_every_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    r = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    want = sorted(repr([_plain(x[columns.index(c)]) for c in names]) for x in r.fetchall())
    got = sorted(repr([_plain(x[c]) for c in names]) for x in df.collect())
    assert got == want


@pytest.mark.parametrize("name", ["bytes_selected", "tokenizer_corpus"])
def test_full_budgets_select_more(spark, name):
    root = "/root/testdata/sf0.1"
    if not os.path.isdir(root):
        pytest.skip("no tables here")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    sql = entry.oracle_sql()[name]
    small = set(db.execute(sql).fetchall())
    sql = sql.replace("before < 200000", f"before < {50 * 1024 * 1024}").replace("before < 50000", f"before < {(512 if name == 'tokenizer_corpus' else 50 * 1024) * 1024}")
    df = entry.queries()[f"{name}_full"](spark, root)
    got = {tuple(r) for r in df.collect()}
    assert got == set(db.execute(sql).fetchall()) and got > small
    print(name, len(small), len(got))


def test_tokenizers_over_documents(spark):
    """Very long texts and odd characters, which the audit rows don't have."""
    import sentencepiece

    from textquarry.operators.tokens import piece_model

    root = "/root/testdata/sf0.01"
    if not os.path.isdir(root) or not os.path.exists(piece_model()):
        pytest.skip("no tables or tokenizer here")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()}
    known = {i: t for i, t in texts.items() if t is not None}
    assert max(map(len, known.values())) > 10_000
    rows = lambda name: entry.queries()[name](spark, root).collect()

    def ids(t):
        return [1, *(b + 4 for b in t.encode()), 2]

    want = {i: (len(ids(t)), hashlib.sha256(",".join(map(str, ids(t))).encode()).hexdigest()) if t is not None else (None, None) for i, t in texts.items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in rows("byte_tokens_documents")} == want
    assert {r["doc_id"]: r["same"] for r in rows("byte_round_trip_documents")} == dict.fromkeys(known, True)
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert {r["doc_id"]: r["tokens"] for r in rows("piece_tokens_documents")} == {i: len(model.encode(t)) if t is not None else None for i, t in texts.items()}
    assert rows("benchmark_documents")
