"""Reproducible samples: a Feistel permutation of numeric ids, and the hash selection of string ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.keys import strip
from textquarry.functions.sampling import ppm_selected

#: The fixed identifier domain is 0 .. 2**62 - 1: two halves of 31 bits.
HALF_BITS = 31
ROUNDS = 6
#: Modulus of the round function.
PRIME = 2**31 - 1


def round_keys(seed: str, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Factor and summand of each round, from sha256 of seed and number."""
    digests = (hashlib.sha256(f"{seed}\0{k}".encode()).hexdigest() for k in range(rounds))
    return [(int(d[:8], 16) % PRIME, int(d[8:16], 16) % PRIME) for d in digests]


def feistel(identifier: Column | str, keys: Column, half_bits: int = HALF_BITS, rounds: int = ROUNDS) -> Column:
    """Pseudo-random permutation of 0 .. 2**(2*half_bits) - 1, keyed by ``keys`` (array<struct<a, b>>, see :func:`round_keys`).

    A round adds (t * t + b) mod PRIME to the left half by exclusive or, t being
    (right * a + b) mod PRIME: whatever that function is, the whole is a bijection, so
    different ids never collide.  Null outside the domain.
    """
    x = F.col(identifier) if isinstance(identifier, str) else identifier
    x = x.cast("bigint")
    mask = F.lit((1 << half_bits) - 1)
    inside = F.when((x >= 0) & (x < F.lit(1 << 2 * half_bits)), x)
    state = F.struct(F.shiftright(inside, half_bits).alias("l"), inside.bitwiseAND(mask).alias("r"))

    def turn(s: Column, key: Column) -> Column:
        t = (s["r"] * key["a"] + key["b"]) % PRIME
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(((t * t + key["b"]) % PRIME).bitwiseAND(mask)).alias("r"))

    return F.aggregate(F.slice(keys, 1, rounds), state, turn, lambda s: F.shiftleft(s["l"], half_bits).bitwiseOR(s["r"]))


def _key_array(seed: str) -> Column:
    return F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in round_keys(seed)])


def _bound(parts_per_million: int, half_bits: int = HALF_BITS) -> int:
    """Permuted values below this are selected: rate * domain size."""
    return parts_per_million * (1 << 2 * half_bits) // 1_000_000


def _with_rules(df: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """Each row with each of a few rules, without a join."""
    listed = F.array(*[F.struct(F.lit(a).alias("selection_id"), F.lit(b).alias("seed_text"), F.lit(c).alias("ppm")) for a, b, c in rules])
    return df.select("*", F.explode(listed).alias("__rule"))


def sample_numeric(df: DataFrame, id_col: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(selection_id, id_col) of the distinct numeric ids that each (id, seed, ppm) rule selects.

    An id is selected if its permuted value lies under rate * domain size.  That depends on
    nothing but id, seed and rate: the same on every run and partitioning, and a selected
    id stays selected when others are added or the rate grows.  A null id or one outside
    the domain is never selected.
    """
    listed = F.array(*[F.struct(F.lit(a).alias("selection_id"), _key_array(b).alias("keys"), F.lit(_bound(c)).cast("bigint").alias("bound")) for a, b, c in rules])
    hit = F.filter(listed, lambda r: feistel(id_col, r["keys"]) < r["bound"])
    return df.select(id_col, F.explode(F.transform(hit, lambda r: r["selection_id"])).alias("selection_id")).select("selection_id", id_col).distinct()


def sample_records(df: DataFrame, id_col: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(selection_id, id_col) of the records whose stripped id each rule's hash selects.

    Each record comes out once, however often it was delivered; null and blank ids are no
    records.  Selection comes before removing repeats, so only the sample is shuffled.
    """
    ids = df.select(strip(id_col).alias(id_col)).where(F.length(id_col) > 0)
    picked = _with_rules(ids, rules).where(ppm_selected(F.col("__rule.seed_text"), F.col(id_col), F.col("__rule.ppm")))
    return picked.select("__rule.selection_id", id_col).distinct()
