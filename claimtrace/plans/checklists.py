"""Checklists out of documents: items from table rows or page columns, as windows over rows in reading order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtrace.functions import expressions as X
from claimtrace.operators import joins as J
from claimtrace.operators import windows as W

# Cells that say nothing, words of header rows, and the forms of item numbers.
EMPTY = ["", "-", "—", "–", "n/a", "na"]
HEADER_WORDS = ["item no", "item #", "item description", "checklist item", "recommendation"]
SUBITEM = r"(?s)^\(([a-z])\)\s*(.+)$"
LEADING_ID = r"^(\d+[a-z]?)[.)]?\s+(.*)$"
NAMED_ID = r"(?:([A-Z][A-Za-z-]*)\s+)?(\d+(?:\.[0-9a-z]+)+)\s*:\s*"
ITEM_LINE = r"^(.{0,34}?)\s{2,}(\d{1,2})\s{2,}(\S.*)$"


@dataclass(frozen=True)
class Recipe:
    """Where a checklist's table has what; columns count from 0."""

    text_column: int
    topic_column: int | None = None
    id_column: int | None = None
    header_rows: int = 1
    id_in_topic: bool = False
    named_id: bool = False
    carry_id: bool = False
    subitem_letters: bool = False
    strip_prefix: str | None = None
    min_text_words: int = 1


def _clean(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def _at(column: int | None) -> Column:
    return F.lit("") if column is None else F.coalesce(F.get("cells", F.lit(column)), F.lit(""))


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def from_tables(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """``doc, place, id, topic, section, text`` of the items in ``rows`` (``doc, place, cells``).

    A row whose one filled cell isn't the text's names a section; topics, and numbers where the recipe says so, hold
    until the next. Of repeated numbers the first stays.
    """
    order = ["place"]
    rows = rows.withColumn("cells", F.transform(F.coalesce("cells", F.array().cast("array<string>")), _clean))
    said = F.lower(F.array_join("cells", " "))
    header = (F.row_number().over(Window.partitionBy("doc").orderBy("place")) <= recipe.header_rows) & F.array_contains(F.array(*(F.contains(said, F.lit(w)) for w in HEADER_WORDS)), True)
    rows = rows.withColumn("_header", header).filter("not _header")
    filled = F.filter("cells", lambda c: c != "")
    rows = rows.withColumn("_text", _at(recipe.text_column)).withColumn("_is_section", F.col("_text") == "")
    rows = W.carry_forward(rows.withColumn("_s", F.when(F.col("_is_section"), F.get(filled, F.lit(0)))), ["doc"], order, "_s", "section")
    rows = rows.filter(~F.col("_is_section") & ~F.lower("_text").isin(EMPTY))
    own, named = _at(recipe.topic_column), F.regexp_extract(_at(recipe.topic_column), LEADING_ID, 1)
    if recipe.id_in_topic:
        ident, topic = named, F.when(named != "", F.regexp_extract(own, LEADING_ID, 2)).otherwise(_or_null(own))
    else:
        ident, topic = _at(recipe.id_column), _or_null(own)
    rows = W.carry_forward(rows.withColumn("_t", topic).withColumn("_id", ident), ["doc"], order, "_t", "_topic")
    rows = rows.withColumn("topic", F.coalesce(_or_null(F.col("_topic")), "section", F.lit(""))).withColumn("section", F.coalesce("section", F.lit("")))
    long_enough = F.size(F.split("text", r"\s+")) >= recipe.min_text_words
    if recipe.named_id:
        numbers = F.regexp_extract_all("_text", F.lit(NAMED_ID), F.lit(2))
        bodies = F.slice(F.split("_text", NAMED_ID, -1), 2, F.greatest(F.size(numbers), F.lit(1)))
        items = rows.select("doc", "place", "topic", "section", F.posexplode(F.arrays_zip(numbers.alias("id"), bodies.alias("text"))).alias("_k", "_i"))
        items = items.select("doc", "place", "_k", F.col("_i.id").alias("id"), "topic", "section", F.trim("_i.text").alias("text")).filter("id is not null and text <> ''")
    else:
        rows = rows.withColumn("_id", F.expr("trim(BOTH ' *†‡§.' FROM _id)"))
        rows = W.carry_forward(rows.withColumn("_stem", _or_null(F.regexp_replace("_id", "[a-z]$", ""))), ["doc"], order, "_stem", "_last")
        ident = F.when((F.col("_id") == "") & F.lit(recipe.carry_id), F.coalesce("_last", F.lit(""))).otherwise(F.col("_id"))
        text = F.col("_text")
        if recipe.subitem_letters:
            letter = F.regexp_extract("_text", SUBITEM, 1)
            ident = F.when(letter != "", F.concat(F.coalesce("_last", ident), letter)).otherwise(ident)
            text = F.when(letter != "", F.trim(F.regexp_extract("_text", SUBITEM, 2))).otherwise(text)
        if recipe.strip_prefix:
            text = F.trim(F.regexp_replace(text, recipe.strip_prefix, ""))
        items = rows.select("doc", "place", F.lit(0).alias("_k"), ident.alias("id"), "topic", "section", text.alias("text")).filter("id <> ''")
    return J.first_of(items.filter(long_enough), ["doc", "id"], ["place", "_k"]).select("doc", "place", "id", "topic", "section", "text")


def from_columns(pages: DataFrame, split: int, min_text_words: int = 4) -> DataFrame:
    """``doc, id, topic, text`` of items on ``pages`` (``doc, page, text``) that are set in two columns, cut at ``split``.

    An item starts on a line with a number between wide gaps. The lines up to the next item belong to it: what stands
    left of where its text began is its topic's, the rest its text's.
    """
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\r?\n")).alias("line", "_whole"))
    halves = F.array(F.substring("_whole", 1, split), F.substring(F.col("_whole"), F.lit(split + 1), F.length("_whole")))
    lines = lines.select("doc", "page", "line", F.posexplode(halves).alias("half", "_half")).withColumn("_half", F.rtrim("_half")).filter("trim(_half) <> ''")
    number, body = F.regexp_extract("_half", ITEM_LINE, 2), F.regexp_extract("_half", ITEM_LINE, 3)
    upto = Window.partitionBy("doc", "page", "half").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    started = F.struct(number.alias("id"), (F.length("_half") - F.length(body)).alias("margin"), F.col("line").alias("at"))
    lines = lines.withColumn("_item", F.last(F.when(number != "", started), ignorenulls=True).over(upto)).filter("_item is not null")
    first, margin = F.col("_item.at") == F.col("line"), F.col("_item.margin")
    topic = F.when(first, F.trim(F.regexp_extract("_half", ITEM_LINE, 1))).otherwise(F.trim(F.substring(F.col("_half"), F.lit(1), margin)))
    text = F.when(first, F.trim(body)).otherwise(F.trim(F.substring(F.col("_half"), margin + 1, F.length("_half"))))
    parts = lines.select("doc", "page", "half", F.col("_item.at").alias("at"), F.col("_item.id").alias("id"), "line", topic.alias("topic"), text.alias("text"))
    joined = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line", c))), lambda x: x[c]), lambda x: x != ""), " ")
    items = parts.groupBy("doc", "page", "half", "at", "id").agg(joined("topic").alias("topic"), joined("text").alias("text"))
    items = items.filter(F.size(F.split("text", r"\s+")) >= min_text_words)
    return J.first_of(items, ["doc", "id"], ["page", "half", "at"]).select("doc", "id", "topic", "text")


def unfounded(items: DataFrame, documents: DataFrame, words: int | None = None) -> DataFrame:
    """Items whose text, or its first ``words`` words, isn't in the document (``doc, text``) that they were read from."""
    text = F.col("text") if words is None else F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, words), " ")
    both = items.withColumn("_said", text).join(documents.select("doc", F.col("text").alias("_in")), "doc", "left")
    return both.filter(~X.contains_quote(F.coalesce("_in", F.lit("")), F.col("_said"))).drop("_said", "_in")
