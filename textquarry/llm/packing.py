"""Filling fixed-capacity containers (sum-of-squares packing)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items packed together by one task; waste per group is a few containers.
GROUP_ITEMS = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item (0, 1, ...), placed one after the other.

    An item goes where the sum over gaps of (open containers with that gap) squared
    becomes smallest; a new container is opened only if that is strictly better.  Of equal
    places the smallest gap is taken.  Sizes must lie in 1..capacity.
    """
    placed = np.empty(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.float32)
    count[0] = -0.5  # a full container counts nothing
    there = np.full(capacity + 1, -np.inf, np.float32)  # count where positive
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        if s == capacity:
            placed[i] = opened
            opened += 1
            continue
        change = count[: capacity - s] - there[s:capacity]
        k = int(change.argmin())
        if 2 * change[k] + 2 <= 2 * count[capacity - s] + 1:
            gap = k + s
            box = stacks[gap].pop()
            count[gap] -= 1
            there[gap] = count[gap] if count[gap] > 0 else -np.inf
            left = k
        else:
            box, left = opened, capacity - s
            opened += 1
        placed[i] = box
        if left:
            stacks[left].append(box)
            count[left] += 1
            there[left] = count[left]
    return placed


def pack(sizes: DataFrame, id_col: str, size_col: str, limits: list[tuple[str, int]], items: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Assign every item of ``sizes`` to a container, for each (limit_id, capacity).

    Result: limit_id, container_id, ``id_col``, part_no, part_tokens, first_token.  An
    item larger than the capacity is divided into full containers and a rest that is
    packed like other items; no other item is divided.  Items of size 0 or null take no
    room and do not come out; a repeated id is packed as often as it occurs.  ``items``
    is the number of rows, which sets how many groups are packed independently: groups are
    formed by a hash of the id, so no group grows with the data and none is hot.
    """
    if not limits or any(c < 1 for _, c in limits):
        raise ValueError("every capacity must be at least 1")
    groups = max(1, math.ceil(items / group_items))
    id_type = sizes.schema[id_col].dataType.simpleString()
    capacity = dict(limits)
    schema = f"limit_id string, container_id string, `{id_col}` {id_type}, part_no int, part_tokens int, first_token bigint"

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(frames)).sort_values([size_col, id_col], ascending=[False, True], kind="stable")
        limit, number = str(key[0]), int(key[1])
        cap = capacity[limit]
        size = group[size_col].to_numpy(np.int64)
        full, rest = size // cap, size % cap
        # a text of exactly the capacity is one full container
        order = np.flatnonzero(rest > 0)
        order = order[np.argsort(-rest[order], kind="stable")]
        box = sum_of_squares(rest[order], cap)
        opened = int(box.max()) + 1 if len(box) else 0
        owner = np.concatenate([np.repeat(np.arange(len(size)), full), order])
        part = np.concatenate([np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full), full[order]])
        where = np.concatenate([opened + np.arange(int(full.sum())), box])
        yield pd.DataFrame({
            "limit_id": limit, "container_id": [f"{number}-{w}" for w in where], id_col: group[id_col].to_numpy()[owner],
            "part_no": part.astype(np.int32) + 1, "part_tokens": np.concatenate([np.full(int(full.sum()), cap), rest[order]]).astype(np.int32),
            "first_token": part * cap,
        })

    each = F.explode(F.array(*[F.lit(k) for k, _ in limits]))
    spread = (
        sizes.where(F.col(size_col) > 0)
        .select(id_col, size_col, F.pmod(F.xxhash64(F.col(id_col)), F.lit(groups)).alias("__group"))
        .select("*", each.alias("__limit"))
    )
    # a group is few bytes and much work: a fixed number of tasks, which is not merged by size
    session = sizes.sparkSession
    tasks = min(groups * len(limits), max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism))
    return spread.repartition(tasks, "__limit", "__group").groupBy("__limit", "__group").applyInPandas(run, schema)


def waste(packed: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """Containers, tokens and the share of unused room of each limit."""
    capacity = F.create_map(*[F.lit(x) for pair in limits for x in pair])
    by_box = packed.groupBy("limit_id", "container_id").agg(F.sum("part_tokens").alias("used"))
    total = by_box.groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return total.select("limit_id", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * capacity[F.col("limit_id")])).alias("unused_share"))
