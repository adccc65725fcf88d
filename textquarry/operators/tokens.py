"""Byte tokens, next-token pairs, and a SentencePiece hook."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from textquarry.functions.binding import bind
from textquarry.functions.text import line_feeds
from textquarry.operators.registry import ContractError, require, unique

#: Fixed values of the byte tokenizer.
PAD, BOS, EOS, UNKNOWN, OFFSET, VOCABULARY = 0, 1, 2, 3, 4, 260


def byte_count(text: Column | str, bos: bool = False, eos: bool = False) -> Column:
    return F.octet_length(text) + int(bos) + int(eos)


def byte_ids(text: Column | str, bos: bool = False, eos: bool = False) -> Column:
    """Ids of the byte tokenizer; an empty text gives only the special ids asked for."""
    text = F.col(text) if isinstance(text, str) else text
    digits = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    body = F.transform(digits, lambda x: F.conv(x, 16, 10).cast("int") + OFFSET)
    return F.when(text.isNotNull(), F.concat(F.array(*[F.lit(BOS)] * bos).cast("array<int>"), body, F.array(*[F.lit(EOS)] * eos).cast("array<int>")))


def byte_text(ids: Column | str) -> Column:
    """Text of byte ids without the special ones; null where the bytes are no UTF-8 or an id is too large."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    kept = F.filter(ids, lambda x: x >= OFFSET)
    raw = F.unhex(F.array_join(F.transform(kept, lambda x: F.lpad(F.hex(x - OFFSET), 2, "0")), ""))
    sound = ~F.exists(ids, lambda x: (x >= VOCABULARY) | (x < 0)) & F.is_valid_utf8(raw.cast("string"))
    return F.when(sound, raw.cast("string"))


def next_token_pairs(ids: Column | str, length: int | None = None) -> Column:
    """struct<input, target> over all ids, or the first ``length`` steps; null for fewer than two ids."""
    ids = F.col(ids) if isinstance(ids, str) else ids

    def shift(part: Column) -> Column:
        n = F.size(part)
        return F.when(n >= 2, F.struct(F.slice(part, F.lit(1), n - 1).alias("input"), F.slice(part, F.lit(2), n - 1).alias("target")))

    return bind(ids if length is None else F.slice(ids, 1, length + 1), shift)


def piece_model(name: str = "piece_bpe_32k.model") -> str:
    """Path of a SentencePiece model; every worker reads it there."""
    return os.path.join(os.environ.get("TEXTQUARRY_TOKENIZERS", "/opt/tokenizers"), name)


def piece_counter(model_file: str):
    """Column function: token count under a SentencePiece model file; null for null."""

    @F.pandas_udf(IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for texts in batches:
            known = texts.fillna("").tolist()
            yield pd.Series([len(x) for x in model.encode(known, num_threads=1)], dtype="Int32").where(texts.notna().to_numpy())

    return count


def piece_facts(model_file: str):
    """Column function: struct<tokens, unknown, exact> of a text under a SentencePiece model."""
    shape = StructType([StructField("tokens", IntegerType()), StructField("unknown", IntegerType()), StructField("exact", BooleanType())])

    @F.pandas_udf(shape)
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for texts in batches:
            known = texts.fillna("").tolist()
            ids = model.encode(known, num_threads=1)
            back = model.decode(ids) if ids else []
            yield pd.DataFrame({"tokens": [len(x) for x in ids], "unknown": [x.count(model.unk_id()) for x in ids], "exact": [a == b for a, b in zip(known, back)]})

    return facts


def piece_ids(model_file: str):
    """Column function: ids under a SentencePiece model file; empty for null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for texts in batches:
            yield pd.Series(model.encode(texts.fillna("").tolist(), num_threads=1))

    return encode


def piece_text(model_file: str):
    """Column function: the text of ids under a SentencePiece model file; null for null."""

    @F.pandas_udf(StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for ids in batches:
            yield pd.Series([None if x is None else model.decode([int(i) for i in x]) for x in ids], dtype=object)

    return decode


def fit_lines(records: DataFrame, partitions: tuple[str, ...] = ("train",), id_col: str = "record_id") -> DataFrame:
    """(id_col, line) of the texts a tokenizer may be fitted on, line ends as U+2028; rows of the holdout are never among them.

    Asking for the holdout, no text at all, and a repeated id are errors.  Fitting itself is
    none of this library's work.
    """
    if "holdout" in partitions:
        raise ContractError("the holdout can't be used to fit a tokenizer")
    chosen = records.where(F.col("partition").isin(*partitions) & F.col("text").isNotNull())
    if chosen.isEmpty():
        raise ContractError("there is no text to fit a tokenizer on")
    require(unique(chosen, id_col), "fit text")
    return chosen.select(id_col, F.replace(line_feeds("text"), F.lit("\n"), F.lit("\u2028")).alias("line"))
