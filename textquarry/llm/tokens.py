"""Encoding a corpus and counting its tokens.

Nulls and empty texts have defined results everywhere: an empty id list and 0 tokens.
Extra columns of the input are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.bpe import BYTES, ByteBpe, byte_bpe_50k, chunks, text_buffer, tokenizer

__all__ = ["BYTES", "PieceCounter", "budget_by_slice", "count_tokens", "encode_corpus"]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row, without special tokens.

    Length-bucketed padded matrices merge the leftmost minimum-rank pair of every row at
    once (:mod:`textquarry.llm.bpe`).  Map-only: no shuffle, nothing is broadcast, memory
    is bounded by one Arrow batch and a bounded piece cache.  A null and an empty text
    both give an empty list.
    """
    path = vocabulary or byte_bpe_50k()
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for a, b in chunks(off):
                e = bpe.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                ids = pa.ListArray.from_arrays(pa.array(e.offsets.astype(np.int32)), pa.array(e.ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


class PieceCounter:
    """Token counts by converging symbol arrays.

    The distinct pre-split pieces of a batch lie end to end in one symbol array.  Each
    round joins all adjacent pairs with the merge ranks, takes the lowest rank of every
    piece and applies it; pieces without a known pair leave.  A tokenizer without merges
    has converged at once.
    """

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe

    def converge(self, symbols: np.ndarray, piece: np.ndarray, n: int) -> np.ndarray:
        """Symbols left in each of ``n`` pieces; ``piece`` is the sorted owner of each symbol."""
        counts = np.bincount(piece, minlength=n)
        while len(symbols) > 1:
            rank = np.where(piece[:-1] == piece[1:], self.bpe._ranks(symbols[:-1], symbols[1:]), np.int32(2**31 - 1))
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            padded = np.append(rank, np.int32(2**31 - 1))
            lowest = np.minimum.reduceat(padded, first)
            size = np.diff(np.append(first, len(symbols)))
            low = np.repeat(lowest, size)
            open_ = low != 2**31 - 1
            hit = open_ & (padded == low)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # of overlapping hits (aaa) every second one applies
            fresh = np.concatenate([[True], np.diff(at) != 1])
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            symbols[at] = self.bpe.merged[padded[at]]
            open_[at + 1] = False
            counts -= np.bincount(piece[at + 1], minlength=n)
            symbols, piece = symbols[open_], piece[open_]
        return counts

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        bpe = self.bpe
        bounds = np.append(bpe.split(data, offsets), len(data))
        if len(bounds) == 1:
            return np.zeros(len(offsets) - 1, np.int64)
        _, first, owner = np.unique(bpe._hashes(data, bounds), return_index=True, return_inverse=True)
        start, length = bounds[:-1][first], np.diff(bounds)[first]
        piece = np.repeat(np.arange(len(first)), length)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(length) - length, length)
        left = self.converge(bpe.byte_id[data[np.repeat(start, length) + within]].copy(), piece, len(first))
        total = np.concatenate([[0], np.cumsum(left[owner])])
        return np.diff(total[np.searchsorted(bounds[:-1], offsets)])


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, out: str = "tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, tokens bigint)``, and the columns ``keep``, of every row under a tokenizer; 0 for a null or empty text.

    ``vocabulary``: path of a byte-level BPE in JSON form (default byte_bpe_50k), or
    :data:`BYTES` for the byte tokenizer, whose symbols never merge: its table of ranks is
    empty, and every piece has converged after the first join.  Map-only; only ids and
    numbers leave Python.
    """
    path = vocabulary or byte_bpe_50k()
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer(path))
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            n = np.concatenate([np.zeros(0, np.int64)] + [counter.counts(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in chunks(off)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *batch.columns[2:]], names=[id_col, out, *keep])

    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(id_col, text_col, *keep).mapInArrow(run, f"`{id_col}` {id_type}, `{out}` bigint{kept}")


def budget_by_slice(counted: DataFrame, *slices: str, tokens: str = "tokens") -> DataFrame:
    """Records and tokens of each combination of the slice columns."""
    return counted.groupBy(*slices).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
