"""The analysis of documents as DataFrames: one Arrow pass, then narrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.text import analyze as T

PARTS = (
    "atoms array<struct<atom:string,start:int,end:int,line:int,kind:string,rule:string,chain:array<string>>>, "
    "bindings array<struct<ns:string,key:string,raw:string,start:int,end:int,line:int,well_formed:boolean>>, "
    "headings array<struct<start:int,level:int,title:string,chain:array<string>>>, "
    "citations array<struct<citekey:string,start:int,narrative:boolean>>, "
    "fences array<struct<start:int,body_start:int,body_end:int,end:int,info:string>>, masked string, n_words int"
)


def parts_of(text: str, terms: tuple[str, ...], rules: tuple, rendered: bool) -> tuple:
    heads, judged, loose = T.headings(text), T.classify(text, rules, terms, rendered), T.bindings(text)
    starts = [x[1] for x in judged]
    around = zip(judged, T.line_numbers(text, starts), T.chains_at(heads, starts), strict=True)
    found = [{"atom": atom, "start": a, "end": b, "line": n, "kind": kind, "rule": rule, "chain": list(chain)} for (atom, a, b, kind, rule), n, chain in around]
    lines = T.line_numbers(text, [x[3] for x in loose])
    bound = [dict(zip(("ns", "key", "raw", "start", "end", "well_formed"), x, strict=True)) | {"line": n} for x, n in zip(loose, lines, strict=True)]
    titles = [dict(zip(("start", "level", "title", "chain"), (*x[:3], list(x[3])), strict=True)) for x in heads]
    cited = [dict(zip(("citekey", "start", "narrative"), x, strict=True)) for x in T.citations(text)]
    blocks = [dict(zip(("start", "body_start", "body_end", "end", "info"), x, strict=True)) for x in T.fences(text)]
    return found, bound, titles, cited, blocks, T.mask(text).replace(T.NUL, " "), T.count_words(text)


def analysed(text: Column, terms: tuple[str, ...] = T.TERMS, rules: tuple = T.RULES, rendered: bool = False) -> Column:
    """Everything that one pass finds in a text, as a struct of PARTS."""
    names = [x.split()[0] for x in PARTS.split(", ")]

    @F.pandas_udf(PARTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([parts_of(t or "", terms, rules, rendered) for t in texts], columns=names)

    return run(text)


def analysed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` (``path`` and a text) with ``parts``. Cache or write it: every gate reads from it."""
    return docs.withColumn("parts", analysed(F.col(text), **options))


def rows(analysis: DataFrame, part: str, *keys: str) -> DataFrame:
    """One part of the analysis as rows beside the document's keys."""
    return analysis.select(*keys, F.inline(F.col(f"parts.{part}")))
