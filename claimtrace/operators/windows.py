"""Window operators: caps with an exact remainder, carry-forward, sections, first mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtrace.session import cut


def capped(df: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each key, in total order, as ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)


def overflow(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """One row per key that has more than ``most`` rows: how many aren't listed."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - most).alias("unlisted")).filter("unlisted > 0")


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null value so far."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(upto))


def until_next(df: DataFrame, group: list[str], order: list[str], start: str, out: str) -> DataFrame:
    """Where the next row of the group starts: the end of a section's body."""
    return df.withColumn(out, F.lead(start).over(Window.partitionBy(*group).orderBy(*order)))


def neighbours_differ(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from both neighbours', which agree with each other: a paragraph in a foreign file."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w)).filter(f"_p = _n and {value} <> _p").drop("_p", "_n")


def running_max(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.max(value).over(upto))


def first_mention(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(at).alias("first_at"))


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``out`` from 1 over all rows in order: sorted by ranges, with each range's count added up before the next."""
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))  # a row per range
    rows = placed.withColumn("_part", part).join(offsets, "_part")
    return rows.withColumn(out, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).drop("_at", "_part", "_before")
