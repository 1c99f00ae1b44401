"""Join operators of claim checking: coverage, containment, as-of, bands, and comparison of snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``left`` whose keys ``right`` lacks: unresolved references, unused values, uncited entries."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def present(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``left`` whose keys ``right`` has."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def covered(points: DataFrame, spans: DataFrame, group: str, start: str, end: str, width: int, how: str = "left_semi") -> DataFrame:
    """Points (``group, start, end``) that lie whole in some span of the same group, by range semi-join; with
    ``left_anti`` those that lie in none.

    Both sides are cut into cells of ``width``, so that a group with very many points and spans is many small joins:
    a span goes to each cell that it touches, a point to the cell of its start.
    """
    p = points.withColumn("_cell", F.floor(F.col(start) / width))
    s = spans.select(F.col(group).alias("_g"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    s = s.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    inside = (F.col(group) == F.col("_g")) & (F.col("_cell") == F.col("_c")) & (F.col("_a") <= F.col(start)) & (F.col("_b") >= F.col(end))
    return p.join(s, inside, how).drop("_cell")


def outside(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, width: int = 512) -> DataFrame:
    """Points (``group, at``) that no span ``[start, end)`` of the same group holds."""
    p = points.withColumn("_s", F.col(at)).withColumn("_e", F.col(at) + 1)
    s = spans.select(group, F.col(start).alias("_s"), F.col(end).alias("_e"))
    return covered(p, s, group, "_s", "_e", width, "left_anti").drop("_s", "_e")


def as_of(points: DataFrame, marks: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """``points`` with ``value`` of the latest mark of the same group at or before each.

    One sort over both sides instead of a join of all pairs; of marks at one place the largest value counts.
    """
    marks = marks.groupBy(group, at).agg(F.max(value).alias(value))
    names = [c for c in points.columns if c != value]
    rows = points.select(*names, F.lit(None).cast(marks.schema[value].dataType).alias(value), F.lit(1).alias("_kind"))
    both = rows.unionByName(marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(group).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(upto)).filter("_kind = 1").drop("_kind")


def latest_before(points: DataFrame, marks: DataFrame, group: str, at: str, order: str, value: str, width: float) -> DataFrame:
    """``points`` (``group, at``) beside ``value`` of the mark of the same group that has the largest ``at`` and then
    ``order`` of those strictly before the point, as ``before``: a struct of the three. Points without one are left out.

    Groups are cut into cells of ``width``, so a large group is many small sorts: each cell's last mark is carried into
    the cells behind it by a pass over a row per cell. NaN comes behind all numbers, and nothing is behind NaN.
    """
    mark = F.struct(F.col(at).alias("at"), F.col(order).alias("order"), F.col(value).alias("value"))
    cell = F.rint(F.col(at).cast("double") / width)
    names = points.columns
    p = points.filter(F.col(at).isNotNull() & F.col(group).isNotNull()).select(*names, cell.alias("_cell"), F.lit(0).alias("_kind"))
    m = marks.filter(F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double"))).select(group, at, F.col(order).alias("_order"), cell.alias("_cell"), F.lit(1).alias("_kind"), mark.alias("_mark"))
    rows = p.unionByName(m, allowMissingColumns=True)
    # a point stands before the marks at its own place
    upto = Window.partitionBy(group, "_cell").orderBy(at, "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_mark", F.last("_mark", ignorenulls=True).over(upto)).filter("_kind = 0")
    cells = p.select(group, "_cell").distinct().unionByName(m.groupBy(group, "_cell").agg(F.max("_mark").alias("_last")), allowMissingColumns=True)
    cells = cells.groupBy(group, "_cell").agg(F.max("_last").alias("_last"))
    behind = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("_last", F.last("_last", ignorenulls=True).over(behind)).withColumnRenamed("_last", "_carried")
    out = near.join(carried, [group, "_cell"]).withColumn("before", F.coalesce("_mark", "_carried"))
    return out.filter("before is not null").select(*names, "before")


def none_near(left: DataFrame, right: DataFrame, group: str, at: str, within: int) -> DataFrame:
    """Rows of ``left`` without a row of ``right`` of the same group at most ``within`` away (band anti-join).

    The nearest neighbours on both sides are found in one pass over the sorted group, so no pairs are made.
    """
    names = left.columns
    rows = left.withColumn("_kind", F.lit(1)).unionByName(right.select(group, at).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    seen = F.when(F.col("_kind") == 0, F.col(at))
    around = Window.partitionBy(group).orderBy(at)
    before = F.last(seen, True).over(around.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, True).over(around.rangeBetween(0, Window.unboundedFollowing))
    near = (F.coalesce(F.col(at) - before <= within, F.lit(False))) | (F.coalesce(after - F.col(at) <= within, F.lit(False)))
    return rows.withColumn("_near", near).filter("_kind = 1 and not _near").select(*names)


def all_of(parts: DataFrame, backing: DataFrame, unit: str, part: str) -> DataFrame:
    """Units all of whose parts ``backing`` has."""
    known = backing.select(part).distinct().withColumn("_hit", F.lit(True))
    return parts.join(known, part, "left").groupBy(unit).agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("_all")).filter("_all").select(unit)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    """``key, status``: added, removed, changed or same, by full outer join; null and NaN equal themselves."""
    b = before.select(key, F.struct(*values).alias("_b"), F.lit(True).alias("_was"))
    a = after.select(key, F.struct(*values).alias("_a"), F.lit(True).alias("_is"))
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, status.alias("status"))


def declared_pairs(values: DataFrame, link: str) -> DataFrame:
    """Each value with the one that its ``link`` names: ``ref, other, state`` (unresolved, differs, displayed
    differently, same)."""
    other = values.select(F.col("ref").alias("other"), F.col("value").alias("_v"), F.col("display").alias("_d"), F.lit(True).alias("_found"))
    rows = values.filter(F.col(link).isNotNull()).withColumn("other", F.col(link)).join(other, "other", "left")
    state = F.when(F.col("_found").isNull(), "unresolved").when(~F.col("value").eqNullSafe(F.col("_v")), "differs").when(~F.col("display").eqNullSafe(F.col("_d")), "displayed differently").otherwise("same")
    return rows.select("ref", "other", state.alias("state"))


#: Names are sent to all tasks up to so many; more meet texts over shared trigrams, and give the same rows.
MOST_BROADCAST = 10_000


def _grams(text: Column) -> Column:
    """All strings of three characters in a text, and all of one, for names that are shorter."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.concat(cut(1), cut(3)))


def _gram(name: Column) -> Column:
    """One string that every text with the name in it has: its first three characters, or its first."""
    return F.substring(name, F.lit(1), F.when(F.length(name) >= 3, 3).otherwise(1))


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of ``t`` and ``name`` of distinct ``texts`` (``t``) and ``names`` (``name``) where the text contains the name."""
    keyed = names.filter("name <> ''").withColumn("_g", _gram(F.col("name")))
    met = texts.withColumn("_g", F.explode(_grams(F.col("t")))).join(keyed, "_g").filter(F.col("t").contains(F.col("name"))).drop("_g")
    return met.unionByName(texts.join(F.broadcast(names.filter("name = ''")), F.lit(True)))


def either_contains(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of ``left`` whose ``a`` and some ``b`` of ``right`` contain one another (either way, by any case)."""
    names = right.select(F.lower(b).alias("name")).filter("name is not null").distinct()
    low = F.lower(F.col(a))
    if names.count() <= MOST_BROADCAST:
        return left.join(F.broadcast(names), low.contains(F.col("name")) | F.col("name").contains(low), "left_semi")
    texts = left.select(low.alias("t")).filter("t is not null").distinct()
    one = contained(texts, names).select("t")
    other = contained(names.withColumnRenamed("name", "t"), texts.withColumnRenamed("t", "name")).select(F.col("name").alias("t"))
    return left.join(one.union(other).distinct(), low == F.col("t"), "left_semi")


#: Passages meet texts over so many words in a row.
RUN = 5


def quoted_in(docs: DataFrame, quotes: DataFrame, text: str, quote: str) -> DataFrame:
    """Rows of ``docs`` beside those of ``quotes`` whose whole ``quote`` the ``text`` contains (both as they are).

    The first and last word of a quote may be parts of words in the text; the words between them are whole there. So the
    hash of its second to sixth word is looked up among the text's runs of five words, and then the whole is compared.
    Quotes of fewer words are compared with all texts while they are MOST_BROADCAST at most, and meet texts over
    trigrams beyond.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    q = quotes.withColumn("_w", words(F.col(quote)))
    long = q.filter(F.size("_w") >= RUN + 2).withColumn("_key", F.xxhash64(F.array_join(F.slice("_w", 2, RUN), " "))).drop("_w")
    d = docs.withColumn("_d", words(F.col(text)))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_d") - RUN + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("_d", i, RUN), " ")))
    found = d.withColumn("_key", F.explode(F.array_distinct(runs))).drop("_d").join(long, "_key").filter(F.col(text).contains(F.col(quote))).drop("_key")
    short = q.filter(F.size("_w") < RUN + 2).drop("_w")
    if short.isEmpty():
        return found
    if short.count() <= MOST_BROADCAST:
        return found.unionByName(docs.join(F.broadcast(short), F.col(text).contains(F.col(quote))))
    pairs = contained(docs.select(F.col(text).alias("t")).distinct(), short.select(F.col(quote).alias("name")).distinct())
    pairs = pairs.select(F.col("t").alias("_text"), F.col("name").alias("_name"))
    return found.unionByName(docs.join(pairs, F.col(text) == F.col("_text")).join(short, F.col(quote) == F.col("_name")).drop("_text", "_name"))


def matched_forms(atoms: DataFrame, values: DataFrame, text: str, display: str, ref: str) -> DataFrame:
    """Atoms with the sorted refs of all values displayed like them, as written or without thousands separators."""
    forms = F.explode(F.array_distinct(F.array(F.col(text), F.regexp_replace(text, "[, ]", ""))))
    shown = values.select(F.col(ref).alias("_ref"), F.explode(F.array_distinct(F.array(F.col(display), F.regexp_replace(display, "[, ]", "")))).alias("_form"))
    return atoms.withColumn("_form", forms).join(shown, "_form").groupBy(*atoms.columns).agg(F.sort_array(F.collect_set("_ref")).alias("candidates"))


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order; the rest are duplicates."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
