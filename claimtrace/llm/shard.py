"""Shards by a Feistel permutation over global row numbers, with cycle walking.

Every row gets a row number that depends on the rows alone, not on files or partitions. A keyed permutation of
``0 .. n-1`` sends it to a place; place ``p`` is slot ``p div shards`` of shard ``p mod shards``. Shards and slots
can so be computed from the row number, and back, without the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtrace.llm.common import mix64, unused

ROUNDS = 4
#: Rows are numbered within so many buckets, by hash. Their counts, one row each, are all that meets in one task.
BUCKETS = 1 << 14
#: Repeated rows are written out again in chunks of so many.
CHUNK = 10_000


class FeistelPermutation:
    """A keyed permutation of ``0 .. n-1``, and its inverse, for n up to 2**62."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        start = np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        self.keys = [mix64(np.array([start ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)])) for i in range(ROUNDS)]

    def _pass(self, x: np.ndarray, keys: list[np.ndarray], back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for key in keys:
            if back:
                left, right = right ^ (mix64(left ^ key) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right ^ key) & self.mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, keys: list[np.ndarray], back: bool) -> np.ndarray:
        """The domain is the next power of 4; what falls outside ``0 .. n-1`` walks on along its cycle."""
        out = self._pass(np.asarray(x, dtype=np.uint64), keys, back)
        while len(at := np.flatnonzero(out >= np.uint64(self.n))):
            out[at] = self._pass(out[at], keys, back)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys[::-1], True)


def permuted(row: Column, n: int, seed: int) -> Column:
    """The place of a row number under the permutation of ``0 .. n-1`` that ``seed`` names."""

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(FeistelPermutation(n, seed).forward(rows.to_numpy()))

    return place(row)


def with_row_numbers(df: DataFrame, out: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with a number from 0, gapless, for each row, and how many rows there are.

    The order is by a hash of the whole row and then by the row itself, so it is the same however the table is split
    into files. Equal rows are counted before anything is shuffled and written out again by many tasks, so a row
    that is repeated without bound does not land in one. Columns must be comparable (no maps).
    """
    own = [c for c in df.columns if c != out]
    names = [f"c{i}" for i in range(len(own))]  # no working column is named so
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(own, names, strict=True)))
    rows = rows.select(*names, F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int").alias("_bucket"))
    distinct = rows.groupBy("_bucket", *names).agg(F.count(F.lit(1)).alias("_copies"))
    sizes = rows.groupBy("_bucket").count().collect()  # BUCKETS rows at most
    total, starts = 0, []
    for bucket, n in sorted((r["_bucket"], r["count"]) for r in sizes):
        starts.append((bucket, total))
        total += n
    first = df.sparkSession.createDataFrame(starts, "_bucket int, _start long")
    inside = Window.partitionBy("_bucket").orderBy(*(F.col(c).asc_nulls_first() for c in names))
    before = F.coalesce(F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = distinct.withColumn("_before", before).join(F.broadcast(first), "_bucket")
    numbered = numbered.withColumn(out, F.col("_start") + F.col("_before"))
    once = numbered.filter("_copies = 1").select(*names, out)
    again = numbered.filter("_copies > 1")
    chunks = again.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(CHUNK).cast("long")))).repartition(*names, "_from")
    last = F.least(F.col("_from") + CHUNK, F.col("_copies")) - 1
    copies = chunks.withColumn("_copy", F.explode(F.sequence(F.col("_from"), last))).select(*names, (F.col(out) + F.col("_copy")).alias(out))
    every = once.unionByName(copies)
    return every.select(*(F.col(n).alias(c) for c, n in zip(own, names, strict=True)), out), total


def shuffled_shards(df: DataFrame, shards: int, seed: int) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` and ``slot``: a reproducible shuffle into ``shards`` shards.

    Counts differ by one at most, and slots of a shard run from 0 without gaps. Nulls in any column, empty and long
    texts and ties are ordinary values; repeated rows take a place each; an empty table gives an empty one; input
    columns named like a result are replaced.
    """
    df = df.drop("row_number", "shard", "slot")
    numbered, n = with_row_numbers(df)
    (at,) = unused(df, "_place")
    placed = numbered.withColumn(at, permuted(F.col("row_number"), n, seed))
    return placed.withColumn("shard", (F.col(at) % shards).cast("int")).withColumn("slot", F.expr(f"{at} div {shards}")).drop(at)
