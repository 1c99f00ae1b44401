"""Mixing sources to target weights by hash-threshold histograms.

Each document has a place on a hash line. Of each source the documents below a threshold are taken, and the
threshold is found from sums of tokens by source and hash bucket: the bucket in which the budget runs out is cut into
finer buckets, twice, and nothing is ever sorted. Budgets of the same source are nested: a smaller one's documents
are among a larger one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtrace.llm.common import WORD, cut, unused, whole

#: Buckets per level, as bits; three levels use the hash's upper 36 bits.
LEVEL_BITS = 12
LEVELS = 3
HASH_BITS = 60


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A document's place on the hash line, from id and text: 60 bits, which SQL engines agree on."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: list[int], most: int) -> DataFrame:
    """``source, source_size`` with ``target``: shares by weight of all sizes, at most ``most`` times the source's own.

    Sources by code point, null last, get ``weights`` in turn. What a source can't use goes to the others by weight
    until none is above its limit. That ends where target = min(limit, level * weight) for one common level. The
    sources with the smallest limit per weight reach their limits; running sums over the sources in that order give
    the level that each prefix would leave, and the first that its next source can't exceed is the one.
    """
    everywhere = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")).withColumn("_limit", F.col("source_size") * most)
    ordered = Window.orderBy((F.col("_limit") / F.col("_weight")), F.col("source").asc_nulls_last())
    by_ratio = ordered.rowsBetween(Window.unboundedPreceding, -1)
    before, used = F.coalesce(F.sum("_limit").over(by_ratio), F.lit(0)), F.coalesce(F.sum("_weight").over(by_ratio), F.lit(0))
    total, weight = F.sum("source_size").over(everywhere), F.sum("_weight").over(everywhere)
    s = s.withColumn("_left", total - before).withColumn("_shared", weight - used).withColumn("_rank", F.row_number().over(ordered))
    level = F.col("_left").cast("double") / F.col("_shared").cast("double")
    fits = F.col("_left") * F.col("_weight") <= F.col("_limit") * F.col("_shared")
    s = s.withColumn("_level", F.min(F.when(fits, F.struct("_rank", level.alias("level")))).over(everywhere)["level"])
    return s.select("source", "source_size", F.least(F.col("_limit").cast("double"), F.col("_level") * F.col("_weight").cast("double")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """For each row of ``budgets`` (``source, budget``, some words of that source) with ``threshold``.

    ``sized`` has ``source, size, _place``. Of all thresholds, the documents placed below this one have words nearest
    to the budget, up to the few documents of one last bucket. Each level sums words by source and bucket; only
    documents of the bucket in which the budget ends come to the next level. ``small``: budgets may be broadcast.
    """
    found = budgets.select("source", "budget", F.lit(0).cast("long").alias("_from"), F.lit(0).cast("long").alias("_sum"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        f, d = (F.broadcast(found) if small else found).alias("f"), sized.alias("d")
        boundary = F.col("d.source").eqNullSafe(F.col("f.source")) & (F.shiftright("_place", shift + LEVEL_BITS) == F.col("_from"))
        keys = [F.col("f.source").alias("source"), "budget", "_from", "_sum", F.shiftright("_place", shift).alias("_bucket")]
        inside = d.join(f, boundary).groupBy(*keys).agg(F.sum("size").alias("_words"))
        running = Window.partitionBy("source", "budget").orderBy("_bucket")
        inside = inside.withColumn("_upto", F.col("_sum") + F.sum("_words").over(running))
        # the first bucket that the budget can't pay in full, on the last level the first that leads away from the
        # budget; where it pays for all, one behind the last
        over = F.col("_upto") > F.col("budget")
        if level == LEVELS:
            over = F.col("_upto") - F.col("budget") > F.col("budget") - (F.col("_upto") - F.col("_words"))
        ends = inside.groupBy("source", "budget", "_from").agg(
            F.min(F.when(over, F.struct("_bucket", (F.col("_upto") - F.col("_words")).alias("_sum")))).alias("_at"),
            F.max("_upto").alias("_all"),
        )
        e, lower = ends.alias("e"), F.shiftleft(F.col("f._from"), LEVEL_BITS)
        same = F.col("e.source").eqNullSafe(F.col("f.source")) & (F.col("e.budget") == F.col("f.budget"))
        behind = F.when(F.col("_all").isNotNull(), F.shiftleft(F.col("f._from") + 1, LEVEL_BITS)).otherwise(lower)
        found = found.alias("f").join(e, same, "left").select("f.source", "f.budget", F.coalesce("_at._bucket", behind).alias("_from"), F.coalesce("_at._sum", "_all", "f._sum").alias("_sum"))
    return found.select("source", "budget", F.shiftleft("_from", HASH_BITS - LEVELS * LEVEL_BITS).alias("threshold"))


#: A table of one row per source is broadcast up to so many sources (some 40 bytes each).
MOST_BROADCAST = 100_000


def _planned(docs: DataFrame, weights: list[int], most: int, text: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, size, _place`` of all documents; and by source its size, target, whole copies, threshold."""
    body = whole(text)
    sized = cut(docs.select("doc_id", "source", n_words(body).alias("size"), place(F.col("doc_id"), body).alias("_place")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = cut(targets(sources, weights, most))
    whole_copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("_copies", whole_copies).withColumn("budget", F.round(F.col("target") - F.col("_copies") * F.col("source_size")).cast("long"))
    # one row per source; where sources are so many that they don't fit, Spark's own choice of join holds
    small = aims.count() <= MOST_BROADCAST
    ends = thresholds(sized, aims.select("source", "budget"), small)
    plan = cut(aims.alias("a").join(ends.alias("e"), F.col("a.source").eqNullSafe(F.col("e.source")), "left").select("a.*", "threshold"))
    return sized, F.broadcast(plan) if small else plan


def _times(plan: Column, at: Column, most: int) -> Column:
    """How often a document at this place is taken. Documents without words cost nothing; ``most`` holds for them too."""
    return F.least(plan["_copies"] + (at < F.coalesce(plan["threshold"], F.lit(0))).cast("long"), F.lit(most).cast("long"))


def mixed(docs: DataFrame, weights: list[int], most: int = 3, text: str = "text") -> DataFrame:
    """One row per document with ``doc_id, source, size, source_size, target, copies, taken``.

    ``copies`` times is the document in the mix, ``taken`` words in all. Each source is taken whole as often as fits
    into its target, and once more below a hash threshold for the rest, so no document is taken over ``most`` times,
    and a source misses its target by a document or so of one last bucket. Null texts have no words; null sources are
    one source; null ids are hashed as the empty string; repeated rows share a place, so they are taken or left
    together; sources without words have target 0; an empty table gives an empty one; other columns are left out.
    """
    sized, plan = _planned(docs, weights, most, text)
    joined = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    times = _times(F.struct("_copies", "threshold"), F.col("_place"), most)
    joined = joined.select("doc_id", "d.source", "size", "source_size", "target", times.alias("copies"))
    return joined.withColumn("taken", F.col("size") * F.col("copies"))


def mixture(docs: DataFrame, weights: list[int], most: int = 3, text: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mixed`` takes it."""
    _, plan = _planned(docs, weights, most, text)
    at, own, times, one = unused(docs, "_place", "_source", "_times", "_time")
    rows = docs.withColumn(at, place(F.col("doc_id"), whole(text)))
    # the plan's columns may be named like the table's, so it comes as one
    joined = rows.join(plan.select(F.col("source").alias(own), F.struct("_copies", "threshold").alias(times)), F.col("source").eqNullSafe(F.col(own)))
    many = _times(F.col(times), F.col(at), most)
    return joined.filter(many > 0).withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), many))).select(*docs.columns)
