"""Scalar text functions: normal forms, hashes, sizes, shingles, simhash."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from textquarry.functions.keys import WHITESPACE_CLASS, strip

#: Shingle width in words, and the key of the shingle hash.
SHINGLE_WORDS = 5
SHINGLE_PERSON = b"FWLLM003"
#: Java classes for what Python's \w and \d mean: no combining marks, any decimal digit.
WORD_CLASS = r"\p{L}\p{N}_"
DIGIT_CLASS = r"\p{Nd}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def line_feeds(text: Column | str) -> Column:
    """CRLF and CR as LF."""
    return F.replace(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_text(text: Column | str) -> Column:
    """LF line ends, no white space at the ends."""
    return strip(line_feeds(text))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))


def normal_text(text: Column | str) -> Column:
    """LF line ends, NFC, every run of white space one space, none at the ends; case is kept."""
    spaced = F.regexp_replace(_c(text), f"[{WHITESPACE_CLASS}]+", " ")
    return _nfc(F.trim(spaced))


def dedup_fingerprint(text: Column | str) -> Column:
    """sha256 of the normal text, in lower hex; null for null."""
    return F.sha2(normal_text(text), 256)


def content_sha256(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def utf8_bytes(text: Column | str) -> Column:
    return F.octet_length(_c(text))


def characters(text: Column | str) -> Column:
    return F.char_length(_c(text))


def line_count(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit("\n")) + 1


def shingles_of(text: str, width: int = SHINGLE_WORDS) -> list[str]:
    """Word shingles of NFC, case-folded text; repeats are kept; a short text is one shingle."""
    words = unicodedata.normalize("NFC", text).casefold().split()
    if len(words) <= width:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def simhash_of(text: str, width: int = SHINGLE_WORDS) -> int:
    """64-bit simhash; a bit is one where the votes are not negative; 0 without shingles."""
    parts = shingles_of(text, width)
    if not parts:
        return 0
    raw = b"".join(hashlib.blake2b(p.encode(), digest_size=8, person=SHINGLE_PERSON).digest() for p in parts)
    ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0)
    return int.from_bytes(np.packbits(2 * ones >= len(parts)).tobytes(), "big")


@F.pandas_udf(ArrayType(StringType()))
def word_shingles(text: pd.Series) -> pd.Series:
    """Word shingles of five words."""
    return text.map(lambda t: None if t is None else shingles_of(t))


@F.pandas_udf(LongType())
def simhash64(text: pd.Series) -> pd.Series:
    """Simhash as a signed bit pattern; null for null."""
    seen: dict[str, int] = {}

    def one(t):
        if t is None:
            return None
        if t not in seen:
            v = simhash_of(t)
            seen[t] = v - (1 << 64) if v >> 63 else v
        return seen[t]

    return pd.Series([one(t) for t in text], dtype="Int64")


def to_hex(fingerprint: Column | str) -> Column:
    """16 lower hex digits of a bit pattern."""
    return F.lpad(F.lower(F.hex(_c(fingerprint))), 16, "0")


def from_hex(text: Column | str) -> Column:
    """Bit pattern of 1 to 16 hex digits in either case; null for anything else."""
    h = F.trim(_c(text))
    return F.when(h.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(h, 16, -10).cast("bigint"))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def likely_near(a: Column | str, b: Column | str, most: int = 3) -> Column:
    """Whether two fingerprints differ in at most ``most`` bits."""
    if not 0 <= most <= 64:
        raise ValueError("the distance must lie in 0..64")
    return hamming(a, b) <= most


def bands(fingerprint: Column | str, count: int = 4) -> Column:
    """array<struct<band, value>>: equal slices of the fingerprint, band 0 the lowest bits."""
    if count < 1 or 64 % count:
        raise ValueError("the number of bands must divide 64")
    width = 64 // count
    mask = (1 << width) - 1
    cut = [F.shiftrightunsigned(_c(fingerprint), b * width) for b in range(count)]
    return F.array(*[F.struct(F.lit(b).alias("band"), (x.bitwiseAND(F.lit(mask)) if width < 64 else x).alias("value")) for b, x in enumerate(cut)])


def band_keys(fingerprint: Column | str, count: int = 4) -> Column:
    """array of "band:hex", the hex as wide as a band."""
    digits = -(-(64 // count) // 4)
    return F.transform(bands(fingerprint, count), lambda x: F.concat(x["band"].cast("string"), F.lit(":"), F.lpad(F.lower(F.hex(x["value"])), digits, "0")))


def sha256_valid(text: Column | str) -> Column:
    return _c(text).rlike("^[0-9a-f]{64}$")


def source_group_id(url: Column | str, record_id: Column | str) -> Column:
    """sha256 of "url:" and the stripped url, or of "id:" and the record id where there is none."""
    address = strip(url)
    return F.sha2(F.when(F.length(address) > 0, F.concat(F.lit("url:"), address)).otherwise(F.concat(F.lit("id:"), _c(record_id))), 256)


def rank_hash(*parts: Column | str) -> Column:
    """Order of a pseudo-random but fixed shuffle: sha256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[_c(p) for p in parts]), 256)


def canonical_id(source_id: Column | str, artifact_id: Column | str, record_id: Column | str) -> Column:
    return F.concat_ws("::", _c(source_id), _c(artifact_id), _c(record_id))
