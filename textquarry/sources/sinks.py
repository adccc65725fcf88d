"""Writers: ordered JSON Lines with digests, split sinks, decision manifests, reports."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, order: str, sorted_keys: bool = False, text: str = "text") -> dict:
    """Write compact JSON Lines in order of a column; refuses an existing path.

    The rows are range-partitioned, so the files in name order are the order asked for and
    nothing is gathered in one task.  Returns rows, text_bytes (UTF-8 bytes of the column
    ``text``, 0 without one), files, bytes, and sha256: of the file where there is one, of
    the files' hex digests in name order, each with a line feed, where there are several.
    """
    columns = sorted(df.columns) if sorted_keys else df.columns
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    size = F.octet_length(text) if text in df.columns else F.lit(0)
    seen = Observation()
    rows = df.orderBy(order).select(line.alias("value"), F.coalesce(size, F.lit(0)).alias("size"))
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("text_bytes")).select("value").write.mode("errorifexists").text(path)
    return {"rows": seen.get["rows"], "text_bytes": seen.get["text_bytes"], **describe(df.sparkSession, path)}


def describe(spark: SparkSession, path: str) -> dict:
    """files, bytes and sha256 (see :func:`json_lines`) of the files under a path.

    Files are digested by the executors in pieces, each whole, so their size doesn't matter;
    the driver gets one row for each file.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted(s.getPath().toString() for s in listed if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    if not names:
        return {"files": 0, "bytes": 0, "sha256": hashlib.sha256().hexdigest()}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:/", "file:///", 1))
                total, value = 0, hashlib.sha256()
                with system.open_input_stream(at) as f:
                    while part := f.read(1 << 20):
                        value.update(part)
                        total += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total]), pa.array([value.hexdigest()])], names=["path", "bytes", "sha256"])

    paths = spark.createDataFrame([(n,) for n in names], "path string").repartition(min(len(names), spark.sparkContext.defaultParallelism))
    rows = sorted(paths.mapInArrow(digest, "path string, bytes bigint, sha256 string").collect(), key=lambda r: r["path"])
    whole = rows[0]["sha256"] if len(rows) == 1 else hashlib.sha256("".join(f"{r['sha256']}\n" for r in rows).encode()).hexdigest()
    return {"files": len(rows), "bytes": sum(r["bytes"] for r in rows), "sha256": whole}


def split_sink(df: DataFrame, accepted: str, excluded: str, status: str = "status", hidden: Iterable[str] = ("text",)) -> dict:
    """Accepted rows with their text, all others (also of null status) without it, to two Parquet paths; returns what :func:`describe` says of both."""
    df.where(F.col(status) == "accept").write.mode("errorifexists").parquet(accepted)
    df.where(~F.col(status).eqNullSafe(F.lit("accept"))).drop(*hidden).write.mode("errorifexists").parquet(excluded)
    return {"accepted": describe(df.sparkSession, accepted), "excluded": describe(df.sparkSession, excluded)}


def without_holdout(df: DataFrame, path: str, partition: str = "partition") -> None:
    """Write train and validation; holdout texts never leave."""
    df.where(F.col(partition).isin("train", "validation")).write.mode("errorifexists").partitionBy(partition).parquet(path)


def report(values: dict, path: str) -> None:
    """A small report as indented JSON."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, indent=2)
        f.write("\n")


def file_digest(path: str, size: int | None = None, sha256: str | None = None) -> tuple[int, str]:
    """Size and sha256 of a file, read in pieces; a pin that doesn't hold is an error."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    digest, total = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
            total += len(part)
    if size is not None and size != total or sha256 is not None and sha256.lower() != digest.hexdigest():
        raise ValueError(f"{path} isn't the file that was pinned")
    return total, digest.hexdigest()
