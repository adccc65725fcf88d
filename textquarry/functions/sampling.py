"""Stateless selection and partition assignment by hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLION = 1_000_000
#: Seed of partition_of unless another is given; a corpus that was split before keeps its own seed.
PARTITION_SEED = "textquarry-split-v1"
#: Of ten thousand places the first 9900 are train, the next 50 validation.
TRAIN_BELOW, VALIDATION_BELOW, PARTITION_BASE = 9_900, 9_950, 10_000


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_mod(modulus: int, *parts: Column | str) -> Column:
    """First eight bytes, big-endian, of sha256(parts joined by NUL), modulo ``modulus``.

    Computed from two 32-bit halves so that all arithmetic stays in bigint.
    """
    digest = F.sha2(F.concat_ws("\0", *[_column(p) for p in parts]), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return ((high % modulus) * (2**32 % modulus) + low) % modulus


def ppm_selected(seed: Column | str, record_id: Column | str, parts_per_million: Column | int) -> Column:
    """Whether a record is in the sample of a seed: the same on every run and partitioning.

    A record once selected stays selected whatever is added.  ``seed`` given as a string
    is a literal.  A null id is never selected.
    """
    if isinstance(parts_per_million, int) and not 1 <= parts_per_million <= MILLION:
        raise ValueError("parts_per_million must lie in 1..1000000")
    seed = F.lit(seed) if isinstance(seed, str) else seed
    record_id = _column(record_id)
    return record_id.isNotNull() & (hash_mod(MILLION, seed, record_id) < parts_per_million)


def partition_of(source_id: Column | str, group_id: Column | str, seed: str = PARTITION_SEED) -> Column:
    """train, validation or holdout of a source group; null for a null or empty part."""
    source_id, group_id = _column(source_id), _column(group_id)
    place = hash_mod(PARTITION_BASE, F.lit(seed), source_id, group_id)
    return F.when(
        (F.length(source_id) > 0) & (F.length(group_id) > 0),
        F.when(place < TRAIN_BELOW, "train").when(place < VALIDATION_BELOW, "validation").otherwise("holdout"),
    )
