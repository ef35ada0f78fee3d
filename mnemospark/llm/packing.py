"""Filling fixed-capacity containers by minimum bin slack.

Which lengths go together depends only on how many items have which length, and there are
no more lengths than the capacity. So that histogram alone, of at most ``capacity`` rows, is
packed: per container, subset sums of the lengths still there are kept in the bits of one
integer until the container is full or the lengths run out; the fullest combination is taken
out as many times as its lengths allow. Items then find their container by their rank among
the items of their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.tokens import n_tokens
from mnemospark.session import cut, partitions_for

#: Items of one length that one task ranks at a time.
RANKED_PER_TASK = 500_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """A combination with the largest item and, beside it, the least unused capacity.

    Larger lengths come first, so that of several equally full combinations the one with the
    larger items is taken.
    """
    largest = max(counts)
    room, use = capacity - largest, {largest: 1}
    if room <= 0:
        return use
    mask, bits, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - use.get(length, 0), room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            layers.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left -= take
            take *= 2
            if bits >> room & 1:
                break
        if bits >> room & 1:
            break
    target = bits.bit_length() - 1
    for length, take, before in reversed(layers):
        if not before >> target & 1:
            target -= length * take
            use[length] = use.get(length, 0) + take
    return use


@dataclass
class Plan:
    """Slots sorted by (length, first rank): ranks from ``first`` on go ``each`` to a container from ``base`` on."""

    key: np.ndarray
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    containers: int

    def of(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, (length.astype(np.int64) << 44) + rank, side="right") - 1
        return self.base[at] + (rank - self.first[at]) // self.each[at]


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Containers for a histogram of lengths between 1 and ``capacity``."""
    counts = {k: v for k, v in histogram.items() if v}
    given: dict[int, int] = dict.fromkeys(counts, 0)
    slots, base = [], 0
    while counts:
        use = fullest(counts, capacity)
        times = min(counts[x] // n for x, n in use.items())
        for x, n in use.items():
            slots.append((x, given[x], n, base))
            given[x] += n * times
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        base += times
    slots.sort()
    a = np.array(slots, np.int64).reshape(-1, 4)
    return Plan((a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3], base)


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048) -> DataFrame:
    """``key, part, n_parts, n_tokens, first_token, container`` for every item of ``df``.

    An item above ``capacity`` tokens is cut into full parts, which fill containers of their
    own, and a rest, which is packed like any other item; no other item is split. Part
    ``part`` of an item has its tokens from ``first_token`` (from 0) on. Containers are named
    ``c<number>``, or ``f<key>/<part>`` for full parts.

    Repeated rows of a key count once (the longest text holds); rows without a key are left
    out. A null or empty text has no tokens and goes to ``c0``. An empty table gives no rows.
    """
    sizes = df.select(F.col(key).alias("k"), n_tokens(F.col(text)).alias("n")).where("k is not null").groupBy("k").agg(F.max("n").alias("n"))
    sizes = cut(sizes)
    full = F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(0).cast("int")
    rest = (F.col("n") - F.col("full").cast("bigint") * capacity).cast("int")
    sizes = sizes.withColumn("full", full).withColumn("rest", rest).withColumn("n_parts", (F.col("full") + F.when((F.col("rest") > 0) | (F.col("full") == 0), 1).otherwise(0)))
    whole = sizes.where("full > 0").select("k", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"), "n_parts")
    whole = whole.select("k", "part", "n_parts", F.lit(capacity).cast("bigint").alias("n_tokens"), F.concat(F.lit("f"), F.col("k").cast("string"), F.lit("/"), "part").alias("container"))

    items = sizes.where("rest > 0").select("k", F.col("full").alias("part"), "n_parts", "rest")
    salts = partitions_for(df.count(), RANKED_PER_TASK) * 8
    items = items.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)))
    counts = items.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("rest", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    # at most capacity rows, whatever the number of items
    histogram = {r["rest"]: r["n"] for r in items.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan(histogram, capacity)

    @F.pandas_udf("bigint")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(slots.of(length.to_numpy(), rank.to_numpy()))

    rank = F.row_number().over(Window.partitionBy("rest", "salt").orderBy("k")) - 1
    ranked = items.withColumn("rank", rank.cast("bigint")).join(offsets, ["rest", "salt"])
    packed = ranked.select("k", "part", "n_parts", F.col("rest").cast("bigint").alias("n_tokens"), F.concat(F.lit("c"), container("rest", F.col("rank") + F.col("before"))).alias("container"))
    none = sizes.where("n = 0").select("k", F.lit(0).alias("part"), F.lit(1).alias("n_parts"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit("c0").alias("container"))
    out = whole.unionByName(packed).unionByName(none)
    return out.select(F.col("k").alias(key), "part", "n_parts", "n_tokens", (F.col("part").cast("bigint") * capacity).alias("first_token"), "container")
