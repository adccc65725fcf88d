"""Near-duplicate pairs by tensored banding over 5-character substrings.

Minhash values are drawn for two collections of ``M`` bands of ``R`` values each; a table
key is a pair (band i of the first, band j of the second), so 2*M*R hash functions serve
M*M tables of 2*R values.  A pair of texts of likeness s meets in a table with
probability (1 - (1 - s**R)**M)**2: 0.980 at 0.7, 0.995 at 0.75, 0.999 at 0.8 with the
defaults.  Candidates are verified exactly.

A text's key (i, j) goes where half key i leads, so a text is sent, with a sketch that
spares most false pairs the verification, to M parts however many there are.  Half keys
that many texts share (of page furniture) are known from a sample; under these a text is
sent by its whole keys.  Whole keys of very many texts are compared in blocks.

Copies meet as one: all steps up to the verification work on distinct normalised texts,
named by a 64-bit hash, so a group of copies makes one key however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.joins import heavy_keys, salted_join
from textquarry.functions.keys import WHITESPACE_CLASS
from textquarry.functions.state import cut
from textquarry.llm.bpe import chunks, text_buffer
from textquarry.llm.components import components

GRAM = 5
M, R = 11, 3
#: The sketch holds four bits of each minhash value; pairs that agree in fewer values are no
#: candidates.  Of 64 values texts of likeness 0.7 agree in 46.0 +- 3.6; 30 lies 4.5
#: deviations below, far above unrelated texts that met under one key (6 + 12 +- 3).
LEAST_EQUAL = 30
_NIBBLES = 0x1111111111111111
#: Distinct texts under one key that are compared at once; larger buckets are compared block by block.
BUCKET = 5_000
#: Texts from which hot half keys are learnt, and the share of them that makes a half key hot.  Only the
#: places where texts meet depend on it, not which ones do.
SAMPLE, HOT_HALF = 5_000, 0.005
#: Groups of more equal texts than this aren't expanded into all their pairs.
COPIES = 1_000


def normalise(text: Column | str) -> Column:
    """Lower case, each run of Unicode white space one space, none at the ends."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(text), f"[{WHITESPACE_CLASS}]+", " "))


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte where each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    b0 = b[at]
    cp = b0.copy()
    wide = np.flatnonzero(b0 >= 0xC0)
    p, v0 = at[wide], b0[wide]
    b1, b2, b3 = b[p + 1] & 63, b[p + 2] & 63, b[p + 3] & 63
    two, three = ((v0 & 0x1F) << 6) | b1, ((v0 & 0x0F) << 12) | (b1 << 6) | b2
    cp[wide] = np.where(v0 < 0xE0, two, np.where(v0 < 0xF0, three, ((v0 & 7) << 18) | (b1 << 12) | (b2 << 6) | b3))
    return cp, at


def gram_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every 5-character substring, and the bounds by text."""
    cp, at = _code_points(data)
    bounds = np.searchsorted(at, off)
    n = np.diff(bounds)
    if len(cp) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    c = cp.astype(np.uint64)
    width = len(c) - GRAM + 1
    h = c[:width].copy()
    for k in range(1, GRAM):
        h *= np.uint64(0x1FFFFF)
        h += c[k : k + width]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the last GRAM - 1 places of each text would reach into the next one
    keep = np.ones(len(c), bool)
    for k in range(1, GRAM):
        tail = bounds[1:] - k
        keep[tail[tail >= bounds[:-1]]] = False
    return h[keep[:width]], np.concatenate([[0], np.cumsum(np.maximum(n - GRAM + 1, 0))])


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)


def minhashes(grams: np.ndarray, bounds: np.ndarray, functions: int) -> np.ndarray:
    """Smallest value of each hash function for every text; all texts must have grams."""
    x = (grams >> np.uint64(16)).astype(np.uint32)
    out = np.empty((functions, len(bounds) - 1), np.uint32)
    for k, a in enumerate(_multipliers(functions)):
        y = x * a
        y ^= y >> np.uint32(15)
        out[k] = np.minimum.reduceat(y, bounds[:-1])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def table_keys(values: np.ndarray, m: int = M, r: int = R) -> tuple[np.ndarray, np.ndarray]:
    """First half keys (m, texts) and keys (m, m, texts) of every text from 2*m*r minhash values."""
    half = values.astype(np.uint64).reshape(2, m, r, -1)
    acc = np.zeros((2, m, half.shape[-1]), np.uint64)
    for k in range(r):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + half[:, :, k] + np.uint64(k + 1))
    number = np.arange(m * m, dtype=np.uint64).reshape(m, m, 1) * np.uint64(0xD6E8FEB86659FD93)
    first = _mix(acc[0] + np.arange(m, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93))
    return first, _mix((acc[0][:, None, :] * np.uint64(3) + acc[1][None, :, :]) ^ number)


def sketch(values: np.ndarray) -> np.ndarray:
    """Four bits of each of up to 64 minhash values: four uint64 for every text."""
    out = np.zeros((values.shape[1], 4), np.uint64)
    for k, v in enumerate(values[:64]):
        out[:, k // 16] |= ((v >> np.uint32(9)) & np.uint32(15)).astype(np.uint64) << np.uint64(4 * (k % 16))
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of values in which two sketches differ."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(_NIBBLES)).sum(1)


def _differing_column() -> Column:
    """:func:`differing` of the columns mark_a and mark_b (arrays of four bigint)."""
    total = F.lit(0)
    for k in range(4):
        x = F.col("mark_a")[k].bitwiseXOR(F.col("mark_b")[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total += F.bit_count(x.bitwiseAND(F.lit(_NIBBLES)))
    return total


def _signed_texts(batches: Iterator[pa.RecordBatch], m: int, r: int):
    """(names, minhash values) of runs of distinct texts that have grams.  Batches: (name bigint, text)."""
    for batch in batches:
        data, off = text_buffer(batch.column(1))
        names = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in chunks(off, 4_000_000):
            grams, where = gram_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
            _, first = np.unique(names[a:b], return_index=True)
            first = first[np.diff(where)[first] > 0]
            if not len(first):
                continue
            first.sort()
            size = np.diff(where)[first]
            take = np.repeat(where[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield names[a:b][first].astype(np.int64), minhashes(grams[take], np.concatenate([[0], np.cumsum(size)]), 2 * m * r)


def _half_keys(m: int, r: int):
    """Map side of the sample: the first half keys of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in _signed_texts(batches, m, r):
            yield pa.RecordBatch.from_arrays([pa.array(table_keys(values, m, r)[0].ravel().view(np.int64))], names=["half"])

    return run


def _blocks(parts: int, m: int, r: int, hot: np.ndarray):
    """Map side: one row per part and run of texts, with the keys, their number by text, names and sketches.

    ``hot``: sorted half keys under which a text goes by its whole keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, values in _signed_texts(batches, m, r):
            half, keys = table_keys(values, m, r)
            marks = sketch(values)
            at = np.minimum(np.searchsorted(hot, half), max(0, len(hot) - 1))
            known = hot[at] == half if len(hot) else np.zeros(half.shape, bool)
            lead = np.where(known[:, None, :], keys, half[:, None, :])
            part = ((lead >> np.uint64(32)) % np.uint64(parts)).astype(np.int64).reshape(m * m, -1).T.ravel()
            flat = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(m * m, -1).T.ravel()
            text = np.repeat(np.arange(len(names)), m * m)
            order = np.argsort(part, kind="stable")
            flat, text, part = flat[order], text[order], part[order]
            ends = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in np.unique(part):
                x, y = ends[p], ends[p + 1]
                used, number = np.unique(text[x:y], return_counts=True)
                rows.append((p, flat[x:y].tobytes(), number.astype(np.uint16).tobytes(), names[used].tobytes(), marks[used].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int32()), *(pa.array([x[k] for x in rows], pa.binary()) for k in range(1, 5))],
                names=["part", "keys", "numbers", "ids", "marks"],
            )

    return run


def _meet(most: int, bucket: int):
    """Reduce side: pairs of texts that share a key and differ in at most ``most`` sketch values; keys of too many texts come out singly."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, ids, marks = [], [], []
        for k, t, i, s in zip(frame["keys"], frame["numbers"], frame["ids"], frame["marks"]):
            number = np.frombuffer(t, np.uint16)
            keys.append(np.frombuffer(k, np.uint32))
            ids.append(np.repeat(np.frombuffer(i, np.int64), number))
            marks.append(np.repeat(np.frombuffer(s, np.uint64).reshape(-1, 4), number, axis=0))
        key, name, mark = np.concatenate(keys), np.concatenate(ids), np.concatenate(marks)
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        size = np.diff(np.append(start, len(sorted_)))
        shared = size > 1
        order, size = order[np.repeat(shared, size)], size[shared]
        key, name, mark = key[order], name[order], mark[order]
        # copies of one text under one key count once
        group = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((name, group))
        group, name, mark, key = group[order], name[order], mark[order], key[order]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (name[1:] != name[:-1])]) if len(group) else np.zeros(0, bool)
        group, name, mark, key = group[fresh], name[fresh], mark[fresh], key[fresh]
        size = np.bincount(group, minlength=len(size)) if len(group) else np.zeros(0, np.int64)
        big = size > bucket
        large = big[group] if len(group) else np.zeros(0, bool)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # in a bucket, all pairs at distance 1, 2, ... of the sorted members
        place = np.arange(len(group))
        live = np.flatnonzero(~large)
        d = 1
        while len(live):
            live = live[live + d < len(group)]
            live = live[group[live + d] == group[live]]
            ok = live[differing(mark[live], mark[live + d]) <= most]
            left.append(name[ok])
            right.append(name[ok + d])
            d += 1
        pairs = pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()
        pairs["big_key"], pairs["mark"] = pd.array([None] * len(pairs), "Int64"), None
        if large.any():
            hot = place[large]
            salt = np.int64(frame["part"].iloc[0]) << np.int64(32)
            extra = pd.DataFrame({"a": name[hot], "b": np.int64(0), "big_key": pd.array(key[hot].astype(np.int64) + salt, "Int64"), "mark": list(mark[hot].view(np.int64))})
            pairs = pd.concat([pairs, extra])
        return pairs

    return run


def hot_halves(texts: DataFrame, rows: int, m: int = M, r: int = R, place: str = "text_hash") -> np.ndarray:
    """Sorted half keys of at least HOT_HALF of a sample of about SAMPLE texts: at most m / HOT_HALF.

    ``place``: the column whose hash says which rows are in the sample.
    """
    every = max(1, rows // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64(place), F.lit(every)) == 0).select("text_hash", "__text")
    seen = sample.mapInArrow(_half_keys(m, r), "half bigint")
    least = max(10, int(HOT_HALF * rows / every))
    hot = [row["half"] for row in seen.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()]
    return np.sort(np.array(hot, np.int64).view(np.uint64))


def candidates(texts: DataFrame, parts: int, hot: np.ndarray, m: int = M, r: int = R, least_equal: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Distinct pairs (a < b) of text hashes that share a table key.  ``texts``: (text_hash, normalised text); ``hot``: :func:`hot_halves`."""
    blocks = texts.mapInArrow(_blocks(parts, m, r, hot), "part int, keys binary, numbers binary, ids binary, marks binary")
    values = min(64, 2 * m * r)
    most = values - (LEAST_EQUAL * values // 64 if least_equal is None else least_equal)
    met = cut(blocks.groupBy("part").applyInPandas(_meet(most, bucket), "a bigint, b bigint, big_key bigint, mark array<bigint>"))
    near = met.where(F.col("big_key").isNull()).select("a", "b")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(_block_pairs(met.where(F.col("big_key").isNotNull()), most, bucket)).distinct()


def _block_pairs(big: DataFrame, most: int, bucket: int) -> DataFrame:
    """Pairs (a < b) of texts (big_key, a, mark) under keys of more than ``bucket`` texts.

    A key's texts are divided into as many blocks as its size asks for, and each pair of
    blocks is compared in its own place: no place holds more than two blocks, whatever the
    size of the key.
    """
    number = big.groupBy("big_key").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket)).cast("int").alias("blocks"))
    # the keys are few: each has more than ``bucket`` texts
    own = big.join(number, "big_key").select("big_key", F.col("a").alias("text"), "mark", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), "blocks")
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    one = sent.where("block = low").select("big_key", "low", "high", F.col("text").alias("x"), F.col("mark").alias("mark_a"))
    two = sent.where("block = high").select("big_key", "low", "high", F.col("text").alias("y"), F.col("mark").alias("mark_b"))
    met = one.join(two, ["big_key", "low", "high"]).where("low < high or x < y").where(_differing_column() <= most)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact likeness of each pair of texts."""
    for batch in batches:
        sides = []
        for k in (2, 3):
            data, off = text_buffer(batch.column(k))
            grams, bounds = gram_hashes(data, off)
            owner = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]) if len(grams) else np.zeros(0, bool)
            sides.append((grams[fresh], owner[fresh]))
        n = batch.num_rows
        grams, owner = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        same = (grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])
        both = np.bincount(owner[1:][same], minlength=n)
        either = np.bincount(owner, minlength=n) - both
        like = both / np.maximum(either, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like)], names=["a", "b", "likeness"])


def similar_texts(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, parts: int | None = None, **banding) -> tuple[DataFrame, DataFrame]:
    """Members ``(id_col, text_hash)`` and pairs ``(a, b, likeness)`` of text hashes, a < b.

    Rows with a null text are no members.  Texts of fewer than five characters, the empty
    one included, resemble only their equals.  Equal texts (after normalising) are one
    member hash and make no pair here.  Rows may repeat; extra columns are ignored.
    """
    spark = df.sparkSession
    text = normalise(text_col)
    named = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), text.alias("__text")).select(id_col, F.xxhash64("__text").alias("text_hash"), "__text")
    members = cut(named.select(id_col, "text_hash"))
    rows = members.count()
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 10_000, 1)
    hot = hot_halves(named, rows, banding.get("m", M), banding.get("r", R), id_col)
    found = cut(candidates(named.select("text_hash", "__text"), parts, hot, **banding))
    used = found.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct()
    # one row stands for each text; only its id is looked up among the texts
    chosen = members.join(used, "text_hash", "left_semi").groupBy("text_hash").agg(F.min(id_col).alias(id_col))
    raw = df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("__raw")).join(chosen, id_col).groupBy("text_hash").agg(F.collect_set("__raw").alias("raws"))
    # a repeated id may bring several texts along
    own = F.filter(F.transform("raws", normalise), lambda t: F.xxhash64(t) == F.col("text_hash"))
    bodies = raw.select("text_hash", own[0].alias("body"))
    pairs = (
        found.join(bodies.select(F.col("text_hash").alias("a"), F.col("body").alias("body_a")), "a")
        .join(bodies.select(F.col("text_hash").alias("b"), F.col("body").alias("body_b")), "b")
        .select("a", "b", "body_a", "body_b")
        .mapInArrow(_likeness, "a bigint, b bigint, likeness double")
        .where(F.col("likeness") >= threshold)
    )
    return members, pairs


def similar_rows(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, copies: int = COPIES, **banding) -> DataFrame:
    """Every pair of rows (id_a < id_b) whose texts have at least the likeness, copies included.

    A group of more than ``copies`` equal texts comes out as pairs with its smallest
    member, which alone stands for the group in pairs with other texts: no link between
    different texts is lost, and no group gives more rows than it has members.
    """
    members, pairs = similar_texts(df, id_col, text_col, threshold, **banding)
    pairs = cut(pairs)
    touched = pairs.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct().withColumn("touched", F.lit(True))
    groups = members.groupBy("text_hash").agg(F.countDistinct(id_col).alias("n"), F.min(id_col).alias("first"))
    needed = groups.join(touched, "text_hash", "left").where("touched or n > 1").select("text_hash", "n", "first")
    kept = cut(members.distinct().join(needed, "text_hash"))
    large = F.col("n") > copies
    named = kept.where(~large | (F.col(id_col) == F.col("first")))
    a = named.select(F.col("text_hash").alias("a"), F.col(id_col).alias("x"))
    b = named.select(F.col("text_hash").alias("b"), F.col(id_col).alias("y"))
    across = pairs.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    within = a.join(b, a["a"] == b["b"]).where("x < y").select("x", "y")
    star = kept.where(large & (F.col(id_col) != F.col("first"))).select(F.col("first").alias("x"), F.col(id_col).alias("y"))
    return across.unionByName(within).unionByName(star).select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))


def classes(members: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Connected groups: (id_col, class_id, links).

    ``class_id`` is the smallest id of the class; ``links`` the number of other texts of at
    least the likeness, copies not counted.  Rows without any likeness form their own
    class.  Groups of copies are joined by their one text; heavy ones are spread.
    """
    label = components(pairs.select("a", "b")).withColumnRenamed("node", "text_hash")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("text_hash")).groupBy("text_hash").agg(F.count(F.lit(1)).alias("links"))
    texts = cut(
        members.groupBy("text_hash").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("n")).join(label, "text_hash", "left").join(degree, "text_hash", "left")
        .select("text_hash", "__first", "n", F.coalesce("label", "text_hash").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    named = texts.join(texts.groupBy("label").agg(F.min("__first").alias("class_id")), "label").select("text_hash", "class_id", "links")
    heavy = heavy_keys(texts, ["text_hash"], least=1_000)
    return salted_join(members.distinct(), named, ["text_hash"], heavy, F.col(id_col)).select(id_col, "class_id", "links")
