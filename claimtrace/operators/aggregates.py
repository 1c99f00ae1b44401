"""Aggregations: duplicate quantities, densities, odds ratios, deferral by stage, discrimination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the stages of a manuscript, in order.
STAGES = ("design", "analysis", "drafting", "internal-review", "submission")


def duplicate_quantity(values: DataFrame, key: Column) -> DataFrame:
    """Quantities that two or more refs publish: ``refs``, how many displays, and the severity that follows."""
    grouped = values.groupBy(key.alias("quantity")).agg(F.count_distinct("ref").alias("n_refs"), F.count_distinct("display").alias("n_displays"))
    return grouped.filter("n_refs >= 2").withColumn("severity", F.when(F.col("n_displays") > 1, "fail").otherwise("warn"))


def density(texts: DataFrame, group: list[str], hits: Column, words: Column, per_1000: float, least: int = 200) -> DataFrame:
    """Hits per 1000 words of each group; ``fires`` above the limit, and never under ``least`` words."""
    sums = texts.groupBy(*group).agg(F.sum(hits).alias("hits"), F.sum(words).alias("words"))
    rate = F.col("hits") * 1000.0 / F.col("words")
    return sums.withColumn("rate", F.when(F.col("words") > 0, rate).otherwise(0.0)).withColumn("fires", (F.col("words") >= least) & (F.col("rate") > per_1000))


def odds_ratio(df: DataFrame, exposed: Column, case: Column, z: float = 1.96) -> DataFrame:
    """The 2 x 2 table ``a, b, c, d``, its odds ratio, and the interval from the standard error of its logarithm."""
    t = df.agg(
        F.count_if(exposed & case).alias("a"), F.count_if(exposed & ~case).alias("b"),
        F.count_if(~exposed & case).alias("c"), F.count_if(~exposed & ~case).alias("d"),
    )
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    ror, se = (a / b) / (c / d), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return t.withColumn("ror", ror).withColumn("low", F.exp(F.log(ror) - z * se)).withColumn("high", F.exp(F.log(ror) + z * se))


def n_pct(df: DataFrame, group: list[str], level: str) -> DataFrame:
    """``n`` and ``pct`` of each level within its group."""
    counts = df.groupBy(*group, level).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*group)))


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), stage)


def deferred(findings: DataFrame, binds: DataFrame, here: str) -> DataFrame:
    """Failures of codes that bind from a later stage on become notes, with the stage when they are due.

    Codes that ``binds`` (``code, due``) doesn't list bind from the first stage on, so deferring never hides them.
    """
    rows = findings.join(F.broadcast(binds), "code", "left")
    later = (F.col("severity") == "fail") & (stage_rank(F.coalesce("due", F.lit(STAGES[0]))) > STAGES.index(here) + 1)
    return rows.withColumn("due", F.when(later, F.col("due"))).withColumn("severity", F.when(later, "info").otherwise(F.col("severity")))


def discrimination(universe: DataFrame, backing: DataFrame, text: str) -> DataFrame:
    """How many numbers of each ``universe`` the backing set has by chance, and what a match so is worth."""
    known = backing.select(text).distinct().withColumn("_hit", F.lit(1))
    rows = universe.join(known, text, "left").groupBy("universe").agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hits"))
    share = F.col("hits") / F.col("n")
    return rows.withColumn("verdict", F.when(share > 0.5, "worthless").when(share > 0.2, "weak").otherwise("informative"))
