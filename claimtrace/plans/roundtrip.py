"""Edited documents: the three-way join of paragraphs, moves, and annotated copies as relations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtrace.functions import expressions as X
from claimtrace.text import analyze as T
from claimtrace.text import paragraphs as P


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """``path, id, source, start`` of each paragraph of prose of ``docs`` (``path, text``)."""

    @F.pandas_udf("array<struct<id:string,source:string,start:int>>")
    def cut(paths: pd.Series, texts: pd.Series) -> pd.Series:
        found = ([dict(zip(("id", "source", "start"), p, strict=True)) for p in P.paragraphs(a, t, T.front_matter(t))] for a, t in zip(paths, texts.fillna(""), strict=True))
        return pd.Series(list(found), dtype=object)

    return docs.select("path", F.inline(cut("path", "text")))


def realigned(source: Column, rendered: Column, returned: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for three in batches:
            yield pd.Series([P.realigned(*x) for x in zip(*three, strict=True)], dtype=object)

    return run(source, rendered, returned)


def merged(known: DataFrame, rendered: DataFrame, returned: DataFrame) -> DataFrame:
    """Known paragraphs (``id, path, source, start``) with ``state`` and ``rebuilt``, from what was built and what came
    back (``id, text``): absent, unchanged, merged, or refused, where a bound number or a citation was changed."""
    both = known.join(rendered.select("id", F.col("text").alias("_out")), "id", "left").join(returned.select("id", F.col("text").alias("_back")), "id", "left")
    edited = F.col("_back").isNotNull() & F.col("_out").isNotNull() & (F.col("_back") != F.col("_out"))
    both = both.withColumn("rebuilt", F.when(edited, realigned(F.col("source"), F.coalesce("_out", F.lit("")), F.coalesce("_back", F.lit("")))))
    state = F.when(F.col("_back").isNull() | F.col("_out").isNull(), "absent").when(~edited, "unchanged").when(F.col("rebuilt").isNull(), "refused").otherwise("merged")
    return both.withColumn("state", state).drop("_out", "_back")


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc, id, was, now`` of paragraphs that came back elsewhere; both sides are ``doc, id, position``. Of documents
    whose order is as it was nothing leaves the JVM."""
    sides = before.select("doc", "id", "position", F.lit(0).alias("side")).unionByName(after.select("doc", "id", "position", F.lit(1).alias("side")))
    row = F.struct(F.col("position").isNull().alias("missing"), "position", "id")
    order = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, row))), lambda x: x["id"])
    changed = sides.groupBy("doc").agg(order(0).alias("was"), order(1).alias("now")).filter(~F.col("was").eqNullSafe(F.col("now")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.string()), ("id", pa.string()), ("was", pa.int32()), ("now", pa.int32())])
        for batch in batches:
            docs, *orders = (batch.column(c).to_pylist() for c in ("doc", "was", "now"))
            rows = [(doc, *x) for doc, *two in zip(docs, *orders, strict=True) for x in P.moved(*two)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    return changed.mapInArrow(found, "doc string, id string, was int, now int")


def marks(atoms: DataFrame) -> DataFrame:
    """``atoms`` (``path, start, end, atom, origin, label, attested``) with ``tier``, and an ``anchor`` that counts within
    each file. Of marks that overlap the first stays, as ``disjoint`` has it; ``numbered`` counts on over files."""
    tiers = atoms.withColumn("tier", X.tier(F.col("origin"), F.col("atom").rlike("[0-9]"), F.col("label"), F.col("attested")))
    return numbered(disjoint(tiers))


def disjoint(spans: DataFrame) -> DataFrame:
    """Of each file's ``spans`` (``path, start, end``), by start, those that don't begin before the last kept one ends.

    A dropped span doesn't hide later ones, however long it is, so a running maximum won't do: one pass over each file's
    sorted spans keeps the end of the last kept one, and nothing else.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, upto = None, None
        for batch in batches:
            kept = []
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                if path != file or upto is None or start >= upto:
                    file, upto = path, end
                    kept.append(True)
                else:
                    kept.append(False)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return spans.repartition("path").sortWithinPartitions("path", "start", "end").mapInArrow(keep, spans.schema)


def numbered(spans: DataFrame) -> DataFrame:
    """``anchor`` from 1 over all files in order of path and place: each file's count is added up, so that only a row
    per file meets in one place."""
    inside = Window.partitionBy("path").orderBy("start", "end")
    counts = spans.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return spans.join(offsets, "path").withColumn("anchor", F.row_number().over(inside) + F.col("_before")).drop("_before")


def tier_totals(marked: DataFrame) -> DataFrame:
    return marked.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
