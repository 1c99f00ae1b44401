"""G3 for figure scripts: whether they read the results, and numbers typed into them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.operators import joins as J
from claimtrace.plans.gates import finding, together
from claimtrace.rules import plotting as R
from claimtrace.text import analyze as T

NOT_CLAIMS = re.compile("|".join(R.NOT_CLAIMS))
CODES = {"text": "figure-source-text-number", "data": "figure-source-hardcoded-data", "loose": "figure-source-unclassified-number"}


def reads_results(text: Column) -> Column:
    """Whether a script seems to take its values from the results: by their reader, or by their folder and JSON."""
    return text.rlike(R.READS_RESULTS) | (text.rlike(R.NAMES_RESULTS) & text.rlike(R.READS_JSON))


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(suffix == "py", "python").when(suffix == "r", "r")


@lru_cache(maxsize=256)
def _line(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str]]]:
    """Of a line the stretches that claim nothing, and its atoms with their kinds; lines with many numbers are read once."""
    return [m.span() for m in NOT_CLAIMS.finditer(text)], [(a, b, kind) for _, a, b, kind, _ in T.classify(text)]


def claims(text: str, column: int) -> bool:
    """Whether the number at ``column`` of a line is prose that nothing exempts. Only its own place counts, so a
    number elsewhere in the line excuses nothing."""
    free, atoms = _line(text)
    if _holding(free, column):
        return False
    around = _holding(atoms, column)
    return bool(around) and around[2] == "unclassified"


def _holding(spans: list[tuple], column: int) -> tuple | None:
    """Of sorted spans without overlaps the one that holds a place."""
    i = bisect_right(spans, column, key=lambda x: x[0]) - 1
    return spans[i] if i >= 0 and column < spans[i][1] else None


def verdict(n: T.CodeNumber) -> str:
    """ok, layout; or what is wrong: text that the figure draws, data typed in, or loose."""
    names = set(n.names)
    if n.in_string:
        ticks = names & R.TICK_LABELS or {x.rsplit(".", 1)[-1] for x in names} & R.TICK_LABELS
        return "text" if not (names & R.FILE_HANDLING or ticks) and claims(n.line_text, n.column) else "ok"
    if names & R.DATA:
        return "data"
    return "layout" if names & R.PARAMETERS or any(map(R.lays_out, names)) else "loose"


def numbers(scripts: DataFrame) -> DataFrame:
    """``path, atom, line, verdict, names, context`` of each number in ``scripts`` (``path, text``, of Python or R)."""

    @F.pandas_udf("array<struct<atom:string,line:int,verdict:string,names:array<string>,context:string>>")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        keys = ("atom", "line", "verdict", "names", "context")
        for texts, languages in batches:
            found = ([dict(zip(keys, (n.text, n.line, verdict(n), list(n.names), n.line_text.strip()), strict=True)) for n in T.numbers_in_code(t, x)] for t, x in zip(texts, languages, strict=True))
            yield pd.Series(list(found), dtype=object)

    known = scripts.withColumn("_language", language(F.col("path"))).filter("_language is not null")
    return known.select("path", F.inline(judged(F.coalesce("text", F.lit("")), "_language")))


def figure_scripts(scripts: DataFrame, judged: DataFrame, allowed: DataFrame, draws_numbers: DataFrame | None = None) -> DataFrame:
    """Findings over ``scripts`` and their ``numbers``. A number that a sidecar declares with a reason (``path, atom,
    why``) is free. Scripts that don't read the results fail, or are warned of if their figures draw no numbers, as
    ``draws_numbers`` (``path, draws``) says; where it says nothing they fail."""
    ignoring = scripts.filter(language(F.col("path")).isNotNull() & ~reads_results(F.coalesce("text", F.lit(""))))
    draws = F.lit(True)
    if draws_numbers is not None:
        ignoring, draws = ignoring.join(draws_numbers, "path", "left"), F.coalesce("draws", F.lit(True))
    wrong = J.missing(judged, allowed.filter(F.length(F.trim("why")) > 0), "path", "atom").filter(F.col("verdict").isin(list(CODES)))
    code = F.element_at(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair)), F.col("verdict"))
    return together(
        finding(ignoring, "G3", "figure-script-ignores-results", F.when(draws, "fail").otherwise("warn"), F.lit("the script never reads the results"), "path"),
        finding(wrong, "G3", code, "fail", F.col("atom"), "path", "line", F.col("context")),
        finding(scripts.filter(language(F.col("path")).isNull()), "G3", "figure-source-unread", "warn", F.lit("no reader for this language"), "path"),
    )
