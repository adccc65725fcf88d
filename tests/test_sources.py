import bz2
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from textquarry.operators.registry import ContractError
from textquarry.sources import files, sinks
from textquarry.streaming.screening import counts, first_copies, partitioned, screened

ROW = {"record_id": "r1", "text": " ก text", "language": "th", "source_id": "s", "license": "cc0", "partition": "train"}


def _lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n", encoding="utf-8")
    return str(path)


def test_strict_json_lines(spark, tmp_path):
    good = _lines(tmp_path / "a.jsonl", [ROW, {**ROW, "record_id": "r2", "partition": "holdout"}])
    assert files.corpus(spark, good).count() == 2
    assert [r["record_id"] for r in files.corpus_partition(spark, good, "holdout").collect()] == ["r2"]
    for n, rows in enumerate(([ROW, ROW], [{**ROW, "language": "de"}], [{**ROW, "text": " "}], [{k: v for k, v in ROW.items() if k != "license"}])):
        with pytest.raises(ContractError):
            files.corpus(spark, _lines(tmp_path / f"bad{n}.jsonl", rows))
    with pytest.raises(files.SourceError):
        files.corpus_partition(spark, good, "dev")
    (tmp_path / "broken.jsonl").write_text("{no json\n")
    with pytest.raises(Exception):
        files.corpus(spark, str(tmp_path / "broken.jsonl")).count()
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(files.SourceError):
        files.benchmark_cases(spark, str(tmp_path / "none.jsonl"))


def test_wiki_and_sentences(spark, tmp_path):
    os.makedirs(tmp_path / "AA")
    _lines(tmp_path / "AA" / "wiki_00", [{"id": "1", "revid": "9", "url": "u", "title": "t", "text": "a\r\nb "}, {"id": "", "text": "x"}, {"id": "2", "text": "  "}, {"id": "3", "text": "c"}])
    got = {r["record_id"]: r["text"] for r in files.wiki_dump(spark, str(tmp_path), "W-").collect()}
    assert got == {"W-1-9": "a\nb", "W-3": "c"}
    p = tmp_path / "s.tsv.bz2"
    p.write_bytes(bz2.compress("1\teng\tone\ttab \n\n2\teng\t\n".encode()))
    assert [tuple(r) for r in files.sentences(spark, str(p), "eng").collect()] == [("1", "eng", "one\ttab")]
    assert files.sentences(spark, str(p), "eng", clean=False).first()["text"] == "one\ttab "
    with pytest.raises(files.SourceError):
        files.sentences(spark, str(p), "tha")


def test_file_order(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text("".join(f"{i}\teng\ttext {i % 7}\n" for i in range(200)))
    got = files.first_sentences(spark, str(p), "eng").collect()
    assert sorted(int(r["sentence_id"]) for r in got) == list(range(7))
    spark.range(20).coalesce(1).write.parquet(str(tmp_path / "q"))
    assert all(r["id"] == r["file_row_number"] for r in files.shard_rows(spark, str(tmp_path / "q")).collect())


def test_shards_and_configs(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, "t").alias("text")).write.parquet(str(tmp_path / "p"))
    with pytest.raises(files.SourceError):
        files.shard(spark, str(tmp_path / "p"))
    shard = files.shard(spark, str(tmp_path / "p"), ("id", "text"))
    assert tuple(files.null_counts(shard, "id", "text").first()) == (3, 0, 1)
    (tmp_path / "c.json").write_text('{\n"schema_version": 1, "a": 2}')
    assert files.config(spark, str(tmp_path / "c.json")).first()["a"] == 2
    with pytest.raises(files.SourceError):
        files.config(spark, str(tmp_path / "c.json"), 2)


def test_external_addresses(tmp_path):
    assert files.external_path("external://ns/a/b", str(tmp_path), "ns") == os.path.realpath(tmp_path / "a" / "b")
    for bad in ("external://other/a", "external://ns/", "external://ns/../x", "external://ns/a//b", "/etc/passwd"):
        with pytest.raises(files.SourceError):
            files.external_path(bad, str(tmp_path), "ns")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "accept", "ข"), ("a", "reject", "x"), ("c", "accept", None)], "record_id string, status string, text string")
    first = sinks.json_lines(df, str(tmp_path / "one"), "record_id", sorted_keys=True)
    again = sinks.json_lines(df.repartition(3), str(tmp_path / "two"), "record_id", sorted_keys=True)
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "one")).collect()]
    assert sorted(x["record_id"] for x in lines) == ["a", "b", "c"] and list(lines[0]) == ["record_id", "status", "text"]
    assert first["bytes"] == again["bytes"] and first["rows"] == 3 and first["text_bytes"] == 4
    one = sinks.json_lines(df.coalesce(1), str(tmp_path / "single"), "record_id", sorted_keys=True)
    whole = b"".join(sorted((p.name, p.read_bytes()) for p in (tmp_path / "one").glob("part-*"))[k][1] for k in range(first["files"]))
    assert len(whole) == first["bytes"] == one["bytes"]
    if one["files"] == 1:
        assert one["sha256"] == hashlib.sha256(next((tmp_path / "single").glob("part-*")).read_bytes()).hexdigest()
    assert sinks.json_lines(df.where("false"), str(tmp_path / "none"), "record_id")["rows"] == 0
    with pytest.raises(Exception):
        sinks.json_lines(df, str(tmp_path / "one"), "record_id")
    both = sinks.split_sink(df, str(tmp_path / "acc"), str(tmp_path / "exc"))
    assert both["accepted"]["files"] >= 1 and len(both["excluded"]["sha256"]) == 64
    assert spark.read.parquet(str(tmp_path / "exc")).columns == ["record_id", "status"] and spark.read.parquet(str(tmp_path / "acc")).count() == 2
    parts = df.select("record_id", F.when(F.col("record_id") == "a", "holdout").otherwise("train").alias("partition"))
    sinks.without_holdout(parts, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2
    sinks.report({"a": "ก"}, str(tmp_path / "r.json"))
    size, sha = sinks.file_digest(str(tmp_path / "r.json"))
    assert sinks.file_digest(str(tmp_path / "r.json"), size, sha.upper()) == (size, sha)
    with pytest.raises(ValueError):
        sinks.file_digest(str(tmp_path / "r.json"), size + 1)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "same text", "2026-01-01 00:00:00"), (2, "same  text", "2026-01-01 00:01:00"), (3, "x a@b.org y", "2026-01-01 00:02:00")]
    spark.createDataFrame(rows, "id int, text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(src)
    schema = "id int, text string, at timestamp"
    stream = partitioned(screened(first_copies(spark.readStream.schema(schema).parquet(src), "at", "1 hour")), "status", "dedup_fingerprint")
    q = stream.writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select id, status, findings, partition from out").collect()
    assert len(got) == 2 and {r["status"] for r in got} == {"accept", "quarantine"} and all(r["partition"] for r in got)
    q = counts(spark.readStream.schema(schema).parquet(src), "at", "1 minute", "10 minutes").writeStream.format("memory").queryName("n").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select records from n").first()[0] == 3
