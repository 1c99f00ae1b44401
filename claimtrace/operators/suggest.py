"""Suggestions for references that name nothing: the most similar known names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST, LEAST_RATIO = 3, 0.6  # fixed
#: Names and misses are compared in blocks of about so many of each.
NAMES_AT_ONCE, MISSES_AT_ONCE = 5_000, 200


def _blocks(df: DataFrame, ref: str, most: int) -> tuple[DataFrame, int]:
    names = df.select(ref).filter(F.col(ref).isNotNull()).distinct()
    n = -(-names.count() // most) or 1
    return names.withColumn("_block", F.pmod(F.xxhash64(ref), F.lit(n)).cast("int")), n


def _all(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def suggestions(missing: DataFrame, known: DataFrame, ref: str) -> DataFrame:
    """Distinct missing refs with up to three known ones of similarity 0.6 or more, the nearest first.

    Every block of misses meets every block of names, whatever their number; of the nearest of each the nearest stay.
    """
    misses, m = _blocks(missing, ref, MISSES_AT_ONCE)
    names, n = _blocks(known, ref, NAMES_AT_ONCE)
    left = misses.select(F.col(ref).alias("miss"), F.col("_block").alias("m"), _all(n).alias("n"))
    right = names.select(F.col(ref).alias("name"), F.col("_block").alias("n"), _all(m).alias("m"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        some, rows = sorted(b["name"]), []
        for x in a["miss"]:
            rows += [(x, y, difflib.SequenceMatcher(None, y, x).ratio()) for y in difflib.get_close_matches(x, some, MOST, LEAST_RATIO)]
        return pd.DataFrame(rows, columns=["miss", "name", "ratio"])

    found = left.groupBy("m", "n").cogroup(right.groupBy("m", "n")).applyInPandas(nearest, "miss string, name string, ratio double")
    best = Window.partitionBy("miss").orderBy(F.desc("ratio"), F.desc("name"))
    top = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= MOST)
    top = top.groupBy("miss").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("candidates"))
    return misses.select(ref).join(top, F.col(ref) == F.col("miss"), "left").select(ref, F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
