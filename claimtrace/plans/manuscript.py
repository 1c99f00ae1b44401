"""Manuscripts as plans: counts, tables as text, bindings put in, numbers bound, claims of guidelines, and the audit's detail."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtrace.functions.display import repr_number
from claimtrace.operators import joins as J
from claimtrace.operators import windows as W
from claimtrace.plans.gates import finding, together
from claimtrace.text import analyze as T
from claimtrace.text import manuscript as M
from claimtrace.text.frames import rows

#: Fixed: unmatched numbers that an audit lists for each file, and the share of project rules from which it warns.
AUDIT_LISTED, PROJECT_SHARE = 40, 0.25
COUNTS = "abstract_words int, main_words int, total_words int, tables int, figures int, sections array<string>, title string"


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` (``path, text``) with COUNTS."""

    @F.pandas_udf(COUNTS)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in COUNTS.split(", ")]
        for texts in batches:
            found = [(M.measured(t), M.without_front_matter(t)[1]) for t in texts]
            yield pd.DataFrame([(c.abstract_words, c.main_words, c.total_words, c.tables, c.figures, list(c.sections), title) for c, title in found], columns=names)

    return docs.withColumn("_c", measure(F.coalesce("text", F.lit("")))).select(*docs.columns, "_c.*")


def journal_counts(docs: DataFrame) -> DataFrame:
    """What a journal's limits are held against, ``name, value``: sums over the manuscript's files."""
    sums = measures(docs).agg(*(F.sum(c).alias(c) for c in ("abstract_words", "main_words", "total_words", "tables", "figures")), F.max(F.length("title")).alias("title_characters"))
    return sums.unpivot([], ["abstract_words", "main_words", "total_words", "tables", "figures", "title_characters"], "name", "value")


def tables_as_text(cells: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """``table_key, text`` of pipe tables from ``cells`` (``table_key, row, col, text``; row -2 is the header, -1 the
    caption). Columns are as wide as their widest cell; ``aligned`` has ``table_key, col, align``."""
    grid = cells.filter("row = -2 or row >= 0").withColumn("text", F.coalesce("text", F.lit("")))
    widths = grid.groupBy("table_key", "col").agg(F.max(F.length("text")).alias("_wide"))
    grid = grid.join(widths, ["table_key", "col"]).withColumn("shown", F.expr("rpad(text, _wide, ' ')"))
    lines = grid.groupBy("table_key", "row").agg(F.array_sort(F.collect_list(F.struct("col", "shown"))).alias("_cells"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("_cells", lambda c: c["shown"]), " | "), F.lit(" |"))
    lines = lines.select("table_key", F.when(F.col("row") == -2, F.lit(-2)).otherwise(F.col("row")).alias("row"), line.alias("line"))
    rules = widths.withColumn("align", F.lit("left"))
    if aligned is not None:
        rules = widths.join(aligned, ["table_key", "col"], "left")
    n = F.greatest(F.col("_wide"), F.lit(3))
    dashes = lambda k: F.repeat(F.lit("-"), k.cast("int"))
    rule = F.when(F.col("align") == "right", F.concat(dashes(n - 1), F.lit(":"))).when(F.col("align") == "center", F.concat(F.lit(":"), dashes(n - 2), F.lit(":"))).otherwise(dashes(n))
    rules = rules.groupBy("table_key").agg(F.array_sort(F.collect_list(F.struct("col", rule.alias("r")))).alias("_rules"))
    rules = rules.select("table_key", F.lit(-1).alias("row"), F.concat(F.lit("| "), F.array_join(F.transform("_rules", lambda c: c["r"]), " | "), F.lit(" |")).alias("line"))
    notes = cells.filter("row = -1 and text <> ''").select("table_key", F.lit(2**31 - 1).alias("row"), F.concat(F.lit("\n: "), F.col("text")).alias("line"))
    every = lines.unionByName(rules).unionByName(notes).groupBy("table_key").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("_lines"))
    return every.select("table_key", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("text"))


def splice(text: Column, changes: Column) -> Column:
    """Texts with their ``changes`` (arrays of ``start, end, new``) put in, from left to right in one pass."""

    @F.pandas_udf("string")
    def put(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([t if c is None or t is None else M.spliced(t, [(x["start"], x["end"], x["new"]) for x in c]) for t, c in zip(texts, lists, strict=True)], dtype=object)

    return put(text, changes)


def _changed(docs: DataFrame, changes: DataFrame, out: str) -> DataFrame:
    """``docs`` with ``out``: the text after ``changes`` (``path, start, end, new``)."""
    lists = changes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("_changes"))
    return docs.join(lists, "path", "left").withColumn(out, splice(F.col("text"), F.col("_changes"))).drop("_changes")


def assembled(docs: DataFrame, analysis: DataFrame, values: DataFrame, tables: DataFrame, figures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``path, text``) with ``rendered``, and findings.

    Bindings give way to displays (``values``: ref, display), to tables as text (``tables``: table_key, text) and to
    links to figures (``figures``: key, file); those that name nothing stay. Front matter goes; two titles that differ,
    and tables and figures that aren't there, are findings.
    """
    bound = rows(analysis, "bindings", "path").filter("well_formed").withColumn("ref", F.concat_ws(".", "ns", "key"))
    known = values.select("ref", F.col("display").alias("new"))
    known = known.unionByName(tables.select(F.concat(F.lit("table."), F.col("table_key")).alias("ref"), F.col("text").alias("new")))
    known = known.unionByName(figures.select(F.concat(F.lit("figure."), F.col("key")).alias("ref"), F.concat(F.lit("![]("), F.col("file"), F.lit(")")).alias("new")))
    changes = bound.join(known, "ref").select("path", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "new")
    titles = measures(docs.select("path", "text")).select("path", "title")
    cut = F.udf(lambda t: T.front_matter(t) if t else 0, "int", useArrow=True)
    heads = docs.select("path", F.lit(0).alias("start"), cut("text").alias("end"), F.lit("").alias("new")).filter("end > 0")
    out = _changed(docs, changes.join(heads.select("path", F.col("end").alias("_body")), "path", "left").filter("_body is null or start >= _body").drop("_body").unionByName(heads), "rendered")
    lost = J.missing(bound.filter("ns in ('table', 'figure')"), known, "ref")
    several = titles.filter("title <> ''").agg(F.count_distinct("title").alias("n"), F.min("path").alias("path")).filter("n > 1")
    return out, together(
        finding(lost.filter("ns = 'table'"), "BUILD", "table-missing", "fail", F.col("key"), "path", "line"),
        finding(lost.filter("ns = 'figure'"), "BUILD", "figure-missing", "fail", F.col("key"), "path", "line"),
        finding(several, "BUILD", "two-titles", "warn", F.col("n").cast("string"), "path"),
    )


def unbound(analysis: DataFrame, docs: DataFrame, values: DataFrame) -> DataFrame:
    """Loose numbers with what could bind them: ``path, line, start, end, atom, hint, candidates``."""
    loose = rows(analysis, "atoms", "path").filter("kind = 'unclassified'").select("path", "line", "start", "end", "atom")
    found = J.matched_forms(loose, values, "atom", "display", "ref")
    every = loose.join(found, loose.columns, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))

    @F.pandas_udf("string")
    def hints(around: pd.Series) -> pd.Series:
        return around.map(M.hint)

    near = F.greatest(F.col("start") - M.WINDOW, F.lit(0))
    around = F.replace(F.substring(F.col("text"), near + 1, F.col("end") - near + M.WINDOW), F.lit("\n"), F.lit(" "))
    return every.join(docs.select("path", "text"), "path").withColumn("hint", hints(around)).drop("text")


def bound(docs: DataFrame, suggested: DataFrame) -> DataFrame:
    """``docs`` with ``rebound``: numbers with exactly one candidate as bindings. The rest are left alone."""
    sure = suggested.filter(F.size("candidates") == 1)
    new = F.concat(F.lit("{{"), F.get("candidates", F.lit(0)), F.lit("}}"))
    return _changed(docs, sure.select("path", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), new.alias("new")), "rebound")


#: Fixed: guidelines whose names are looked for, as their authors write them.
GUIDELINES = ("STROBE", "RECORD", "RECORD-PE", "CONSORT", "PRISMA", "STARD", "TRIPOD", "CARE", "SPIRIT", "ARRIVE", "SQUIRE", "CHEERS", "READUS-PV", "MOOSE", "REMARK")
CLAIMING = r"(?i)\b(?:follow(?:s|ed|ing)?|adher(?:e|es|ed|ing)|accord(?:ing|ance)|report(?:s|ed|ing)?|compl(?:y|ies|ied|iant)|conform(?:s|ed|ing)?|guid(?:ed|eline))\b"


def guideline_claims(masked: DataFrame, declared: DataFrame) -> DataFrame:
    """Guidelines that a sentence of ``masked`` (``path, text``) says were followed and that ``declared`` (``guideline``)
    doesn't have, not even as a part of a name. Names are read as written: 'care' claims nothing."""
    names = "|".join(sorted((g.replace("-", r"[-‑ ]?") for g in GUIDELINES), key=len, reverse=True))
    said = masked.select("path", F.explode(F.split("text", r"(?<=[.!?])\s+|\n{2,}")).alias("sentence")).filter(F.col("sentence").rlike(CLAIMING))
    named = said.select("path", F.explode(F.regexp_extract_all("sentence", F.lit(rf"\b({names})\b"), F.lit(1))).alias("guideline"))
    first = named.groupBy(F.upper("guideline").alias("guideline")).agg(F.min("path").alias("path"))
    return finding(J.missing(first, J.either_contains(first, declared, "guideline", "guideline"), "guideline"), "G5", "guideline-claimed-not-declared", "warn", F.col("guideline"), "path")


def project_exemptions(atoms: DataFrame) -> DataFrame:
    """One finding on how many ``atoms`` (``kind, rule``) only the project's own rules accept, by rule; a warning from a
    quarter of all on."""
    by_rule = atoms.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule").startswith("project:")).alias("own"))
    totals = by_rule.agg(F.sum("n").alias("all"), F.sum("own").alias("own"), F.array_sort(F.collect_list(F.when(F.col("own") > 0, F.struct((-F.col("own")).alias("o"), "rule")))).alias("rules")).filter("own > 0")
    listed = F.array_join(F.transform("rules", lambda r: F.concat(r["rule"], F.lit(" ("), (-r["o"]).cast("string"), F.lit(")"))), "; ")
    severity = F.when(F.col("own") / F.col("all") >= PROJECT_SHARE, "warn").otherwise("info")
    return finding(totals, "G2", "project-exemption", severity, F.concat(F.col("own").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(": "), listed))


def audited(docs: DataFrame, backing: DataFrame) -> DataFrame:
    """Each number of unbound papers (``path, text``): ``path, line, atom, state, context``; matched, unmatched or classified.

    Bibliographies are cut off, lines that look like entries count as classified, classification is that of rendered
    text without sections, and of a compound all numbers must be backed (``number``).
    """
    out = "array<struct<line:int,start:int,atom:string,classified:boolean,numbers:array<string>,context:string>>"

    @F.pandas_udf(out)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = []
            for t in texts:
                body = M.without_bibliography(t)
                judged = T.classify(body, rendered=True)
                entry = [M.is_reference(x) for x in body.split("\n")]
                lines = T.line_numbers(body, [x[1] for x in judged])
                found.append([
                    {"line": n, "start": a, "atom": atom, "classified": kind != "unclassified" or entry[n - 1], "numbers": [repr_number(x) for x in M.numbers_of(atom)], "context": M.window(body, a, b, 60)}
                    for (atom, a, b, kind, _), n in zip(judged, lines, strict=True)
                ])
            yield pd.Series(found, dtype=object)

    each = docs.select("path", F.inline(read(F.coalesce("text", F.lit("")))))
    loose = each.filter("not classified").select("path", "start", F.explode("numbers").alias("number"))
    hits = loose.join(backing.select("number").distinct().withColumn("_hit", F.lit(True)), "number", "left").groupBy("path", "start").agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("_all"))
    state = F.when(F.col("classified"), "classified").when(F.col("_all"), "matched").otherwise("unmatched")
    return each.join(hits, ["path", "start"], "left").select("path", "line", "start", "atom", state.alias("state"), "context")


def audit_totals(judged: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return judged.agg(F.count(F.lit(1)).alias("examined"), count("matched"), count("unmatched"), count("classified"))


def audit_listing(judged: DataFrame) -> DataFrame:
    """The first unmatched numbers of each file, and for files with more a row that says how many more."""
    lost = judged.filter("state = 'unmatched'")
    listed = W.capped(lost, ["path"], ["start"], AUDIT_LISTED).select("path", "line", "atom", "context", F.lit(None).cast("long").alias("more"))
    more = W.overflow(lost, ["path"], AUDIT_LISTED).select("path", F.col("unlisted").alias("more"))
    return listed.unionByName(more, allowMissingColumns=True)


def drift_text(drift: DataFrame, most: int = 4) -> DataFrame:
    """``text``: what changed, was added and was removed (``path, status``), four names of each and how many more."""
    named = drift.filter("status <> 'same'").withColumn("_r", F.row_number().over(Window.partitionBy("status").orderBy("path")))
    some = named.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.col("path")))).alias("names"))
    rest = F.when(F.col("n") > most, F.concat(F.lit(" (+"), (F.col("n") - most).cast("string"), F.lit(" more)"))).otherwise("")
    place = F.expr("array_position(array('changed', 'added', 'removed'), status)")
    parts = some.select(place.alias("k"), F.concat("status", F.lit(": "), F.array_join("names", ", "), rest).alias("t"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "; ").alias("text"))
