"""Gates: each a plan from frames to findings. All findings have the columns of ``schemas.FINDINGS``."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimtrace.functions import expressions as X
from claimtrace.operators import aggregates as A
from claimtrace.operators import joins as J
from claimtrace.operators import windows as W
from claimtrace.rules.tables import BINDS, EXEMPT, LINT
from claimtrace.text.frames import rows

LISTED, PHRASES_LISTED, NEAR_CITATION, LEAST_WORDS = 50, 3, 240, 200  # fixed


def finding(df: DataFrame, gate: str, code: str | Column, severity: str | Column, message: Column, path: str | None = None, line: str | None = None, context: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    null = F.lit(None).cast("string")
    return df.select(
        F.lit(gate).alias("gate"), lit(code).alias("code"), lit(severity).alias("severity"), message.alias("message"),
        (F.col(path) if path else null).alias("path"), (F.col(line).cast("int") if line else F.lit(None).cast("int")).alias("line"),
        (F.substring(context, 1, 160) if context is not None else null).alias("context"),
    )


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def fragments_gate(found: DataFrame, late: DataFrame) -> DataFrame:
    """Files that can't be read, and keys that two files publish."""
    return together(
        finding(found.filter("not ok"), "G0", "schema-violation", "fail", F.lit("not a results fragment"), "path"),
        finding(late, "G0", "duplicate-key", "fail", F.concat(F.lit("published before: "), F.col("key")), "path"),
    )


def freshness(fragments: DataFrame, files: DataFrame) -> DataFrame:
    """G1: declared inputs that are missing or changed, and scripts that changed since."""
    # a script may have been recorded with other line ends: ``forms`` are its digests with each of the three
    forms = F.col("forms") if "forms" in files.columns else F.array("sha256")
    now = files.select("path", F.col("sha256").alias("_now"), forms.alias("_forms"))
    inputs = fragments.select(F.col("path").alias("fragment"), F.inline("doc.provenance.inputs")).join(now, "path", "left")
    scripts = fragments.select(F.col("path").alias("fragment"), F.col("doc.provenance.generated_by").alias("path"), F.col("doc.provenance.generated_by_sha256").alias("_then")).filter("path is not null").join(now, "path", "left")
    return together(
        finding(inputs.filter("_now is null"), "G1", "input-missing", "fail", F.col("path"), "fragment"),
        finding(inputs.filter("_now <> sha256"), "G1", "input-changed", "fail", F.col("path"), "fragment"),
        finding(scripts.filter("_now is null"), "G1", "script-missing", "fail", F.col("path"), "fragment"),
        finding(scripts.filter("_then is not null and not array_contains(_forms, _then)"), "G1", "script-newer", "fail", F.col("path"), "fragment"),
    )


def numbers(analysis: DataFrame, values: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Numbers that nothing binds, bindings that name nothing, and published values that nothing quotes.

    Of each document the first 50 loose numbers are listed; one more row tells exactly how many aren't.
    """
    loose = rows(analysis, "atoms", "path").filter("kind = 'unclassified'")
    listed = W.capped(loose, ["path"], ["start"], LISTED)
    more = W.overflow(loose, ["path"], LISTED)
    bound = rows(analysis, "bindings", "path").withColumn("ref", F.concat_ws(".", "ns", "key"))
    named = bound.filter("well_formed")
    quoted = values.filter("quoted")
    own, lit = quoted.filter("ns = 'results'"), quoted.filter("ns = 'lit'")
    shown = J.present(values.filter("not label"), named, "ref").filter(~F.col("display").rlike("[0-9]"))
    out = [
        finding(listed, "G2", "unclassified-number", "fail", F.col("atom"), "path", "line", F.array_join("chain", " > ")),
        finding(more, "G2", "unclassified-number", "fail", F.concat(F.col("unlisted").cast("string"), F.lit(" more")), "path"),
        finding(bound.filter("not well_formed"), "G2", "malformed-placeholder", "fail", F.col("raw"), "path", "line"),
        finding(J.missing(named.filter("ns in ('results', 'lit')"), values, "ref"), "G2", "unresolved-binding", "fail", F.col("ref"), "path", "line"),
        finding(J.missing(own, named, "ref"), "G2", "unquoted-result", "fail", F.col("ref"), "source"),
        finding(J.missing(lit, named, "ref"), "G2", "unused-literature", "warn", F.col("ref"), "source"),
        finding(shown, "G2", "prose-as-value", "warn", F.col("ref"), "source"),
        finding(rows(analysis, "fences", "path").filter(F.col("info").rlike(r"^\{?=|^raw")), "G2", "raw-block", "fail", F.col("info"), "path"),
    ]
    if tables is not None:
        placed = named.filter("ns = 'table'").select(F.col("key").alias("table_key"))
        out.append(finding(J.missing(tables.select("table_key").distinct(), placed, "table_key"), "G2", "unplaced-table", "fail", F.col("table_key")))
    return together(*out)


def exemptions(analysis: DataFrame) -> DataFrame:
    """Counts of accepted atoms by kind and rule, most first."""
    return rows(analysis, "atoms", "path").groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind", "rule")


def intervals(values: DataFrame) -> DataFrame:
    """Bounds that name no estimate, bounds that are there twice, and bounds that don't enclose the estimate."""
    bounds = values.filter("bounds is not null").withColumn("estimate", F.concat_ws(".", "ns", "bounds"))
    known = values.select(F.col("ref").alias("estimate"), F.col("value_double").alias("point"))
    lost = J.missing(bounds, known, "estimate")
    pairs = bounds.join(known, "estimate").groupBy("estimate", "level", "point").agg(
        F.min(F.when(F.col("bound") == "low", F.col("value_double"))).alias("low"), F.max(F.when(F.col("bound") == "high", F.col("value_double"))).alias("high"),
        F.count_if(F.col("bound") == "low").alias("lows"), F.count_if(F.col("bound") == "high").alias("highs"), F.count_if(F.col("value_double").isNull()).alias("odd"),
    )
    name = F.concat_ws(" ", "estimate", "level")
    sound = pairs.filter("lows <= 1 and highs <= 1 and odd = 0 and point is not null")
    return together(
        finding(lost, "G2", "bound-dangling", "fail", F.col("ref"), "source"),
        finding(pairs.filter("lows > 1 or highs > 1"), "G2", "bound-duplicated", "fail", name),
        finding(pairs.filter("odd > 0 or point is null"), "G2", "bound-uncheckable", "fail", name),
        finding(sound.filter("low > high"), "G2", "interval-inverted", "fail", name),
        finding(sound.filter("low <= high and (point < low or point > high) or low is null and point > high or high is null and point < low"), "G2", "estimate-outside-interval", "fail", name),
    )


def interval_order(analysis: DataFrame, values: DataFrame, text: str = "text") -> DataFrame:
    """Sentences that quote the upper bound of an interval before the lower."""
    bound = rows(analysis, "bindings", "path", text).filter("well_formed").withColumn("ref", F.concat_ws(".", "ns", "key"))
    ends = F.regexp_count(F.substring(F.col(text), F.lit(1), F.col("start")), F.lit(r"[.!?](?:\s|$)"))
    used = bound.withColumn("sentence", ends).join(values.filter("bounds is not null").select("ref", "bounds", "level", "bound"), "ref")
    first = used.groupBy("path", "sentence", "bounds", "level").agg(F.min(F.when(F.col("bound") == "low", F.col("start"))).alias("a"), F.min(F.when(F.col("bound") == "high", F.col("start"))).alias("b"), F.min("line").alias("line"))
    return finding(first.filter("a > b"), "G2", "interval-reversed", "fail", F.col("bounds"), "path", "line")


def table_cells(cells: DataFrame, values: DataFrame, code_lists: DataFrame | None = None) -> DataFrame:
    """Cells that aren't what their template and parts make, code cells that differ from their list, and numbers
    in cells that no value displays."""
    made = cells.filter("template is not null and not is_codes")
    wrong = made.filter(~F.col("text").eqNullSafe(X.rebuilt(F.col("template"), F.col("parts"))))
    plain = cells.filter("template is null and row >= 0").withColumn("atom", F.explode(X.atoms_text(F.col("text"))))
    plain = plain.withColumn("form", F.regexp_replace("atom", r"^[(\[<]+|[)\],;:%]+$|,(?=\d)", ""))
    shown = values.select(F.explode(F.array(F.col("display"), F.regexp_replace("display", "[, ]", ""))).alias("form")).distinct()
    place = F.concat_ws(":", "table_key", "row", "col")
    out = [
        finding(wrong, "G2-tables", "composition-does-not-match", "fail", place, context=F.col("text")),
        finding(J.missing(plain, shown, "form"), "G2-tables", "unemitted-table-number", "fail", place, context=F.col("atom")),
        finding(plain.groupBy("table_key", "row", "col", "text").agg(F.count_distinct("atom").alias("n")).filter("n >= 2"), "G2-tables", "typed-composite-cell", "fail", place, context=F.col("text")),
    ]
    if code_lists is not None:
        want = code_lists.select("table_key", F.col("row_idx").alias("row"), F.array_join("codes", ", ").alias("_codes"))
        codes = cells.filter("is_codes").join(want, ["table_key", "row"], "left")
        out.append(finding(codes.filter(~F.col("text").eqNullSafe(F.col("_codes"))), "G2-tables", "code-list-does-not-match", "fail", place, context=F.col("text")))
    return together(*out)


def figures(layers: DataFrame, analysed: DataFrame, values: DataFrame, allowed: DataFrame) -> DataFrame:
    """Drawings that can't be read or have no text, and numbers in them that no value displays and no sidecar allows
    with a reason. ``layers``: path, text, error; ``allowed``: path, atom, why."""
    loose = rows(analysed, "atoms", "path").filter("kind = 'unclassified'")
    shown = values.select(F.explode(F.array(F.col("display"), F.regexp_replace("display", "[, ]", ""))).alias("atom")).distinct()
    free = allowed.filter(F.length(F.trim("why")) > 0)
    return together(
        finding(layers.filter("error is not null"), "G3", "figure-unreadable", "warn", F.col("error"), "path"),
        finding(layers.filter("error is null and trim(text) = ''"), "G3", "figure-no-text-layer", "fail", F.lit("no text layer"), "path"),
        finding(J.missing(J.missing(loose, shown, "atom"), free, "path", "atom"), "G3", "figure-number-unbound", "fail", F.col("atom"), "path"),
    )


def journal(counts: DataFrame, limits: DataFrame, profile_date: str | None, today: str) -> DataFrame:
    """Counts (``name, value``) over or near the journal's limits (``name, most``), and an old profile."""
    state = counts.join(limits, "name").withColumn("state", X.limit_state(F.col("value"), F.col("most")))
    said = F.concat_ws(" ", "name", F.col("value").cast("string"), F.lit("of"), F.col("most").cast("string"))
    out = [finding(state.filter("state = 'over'"), "G4", "over-journal-limit", "fail", said), finding(state.filter("state = 'near'"), "G4", "near-journal-limit", "warn", said)]
    if profile_date:
        old = counts.sparkSession.range(1).filter(X.is_stale(F.lit(profile_date), F.lit(today).cast("date")))
        out.append(finding(old, "G4", "journal-profile-stale", "warn", F.lit(profile_date)))
    return together(*out)


def required(texts: DataFrame, wanted: DataFrame, gate: str, code: str) -> DataFrame:
    """Patterns (``id, pattern``) that no text of the manuscript has."""
    hits = texts.crossJoin(F.broadcast(wanted)).filter(F.regexp_like("text", F.concat(F.lit("(?im)"), F.col("pattern")))).select("id")
    return finding(J.missing(wanted, hits, "id"), gate, code, "fail", F.col("id"))


def checklist(items: DataFrame, answers: DataFrame, headings: DataFrame) -> DataFrame:
    """Items without answer, answers that are no reason, unknown items, and places that no heading names."""
    both = items.select("id").join(answers.withColumn("_got", F.lit(True)), "id", "left")
    said = F.coalesce(F.length(F.trim("where")), F.lit(0)) > 0
    excused = F.coalesce(F.length(F.trim("not_applicable")), F.lit(0)) > 0
    return together(
        finding(both.filter("_got is null"), "G5", "checklist-item-missing", "fail", F.col("id")),
        finding(both.filter(F.col("_got") & ~said & ~excused), "G5", "checklist-item-unanswered", "fail", F.col("id")),
        finding(both.filter(F.col("_got") & excused & X.is_non_reason(F.col("not_applicable"))), "G5", "checklist-non-reason", "fail", F.col("id")),
        finding(J.missing(answers, items, "id"), "G5", "checklist-item-unknown", "warn", F.col("id")),
        finding(answers.filter(said).join(J.either_contains(answers.filter(said), headings, "where", "title").select("id"), "id", "left_anti"), "G5", "checklist-location-unknown", "warn", F.col("id")),
    )


HITS = "array<struct<kind:string,id:string,at:long,hit:string>>"


def lint_hits(raw: Column, masked: Column) -> Column:
    """Every match of the lint rules with its place: artefacts in the raw text, all else in the masked. Matches of
    densities that lie where the rule's word is meant otherwise are left out."""

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rules = [(kind, name, re.compile(pattern, re.M), re.compile(EXEMPT[name]) if name in EXEMPT else None) for kind, name, pattern, _ in LINT]
        for raws, proses in batches:
            out = []
            for text, prose in zip(raws, proses, strict=True):
                found = []
                for kind, name, pattern, exempt in rules:
                    body = text if kind == "artefact" else prose
                    free = [m.span() for m in exempt.finditer(body)] if exempt else []
                    starts = [a for a, _ in free]
                    for m in pattern.finditer(body):
                        i = bisect_right(starts, m.start()) - 1
                        if i < 0 or m.start() >= free[i][1]:
                            found.append({"kind": kind, "id": name, "at": m.start() + 1, "hit": m[0]})
                out.append(found)
            yield pd.Series(out, dtype=object)

    return hits(F.coalesce(raw, F.lit("")), F.coalesce(masked, F.lit("")))


#: Hits named beside a density.
SAMPLED = 8


def lint(docs: DataFrame, analysis: DataFrame, spark: SparkSession) -> DataFrame:
    """Left-over markup, stock phrases, appeals to nobody without a citation near, and cadences by density over all
    documents. Each text is read once for all rules."""
    texts = docs.select("path", "text").join(analysis.select("path", F.col("parts.masked").alias("_masked"), F.col("parts.n_words").alias("_words")), "path")
    found = texts.select("path", "_words", lint_hits(F.col("text"), F.col("_masked")).alias("_hits"))
    hits = found.select("path", F.inline("_hits"))
    listed = W.capped(hits.filter("kind = 'phrase'"), ["path", "id"], ["at", "hit"], PHRASES_LISTED)
    cited = rows(analysis, "citations", "path").select("path", (F.col("start") + 1).cast("long").alias("at"))
    vague = J.none_near(hits.filter("kind = 'vague'"), cited, "path", "at", NEAR_CITATION)
    limits = spark.createDataFrame([(name, float(most)) for kind, name, _, most in LINT if kind == "density"], "id string, most double")
    words = found.agg(F.coalesce(F.sum("_words"), F.lit(0)).alias("words"))
    shown = hits.filter("kind = 'density'").withColumn("hit", F.lower(F.trim("hit")))
    of_rule = shown.groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    named = W.capped(shown.select("id", "hit").distinct(), ["id"], ["hit"], SAMPLED).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("hit")), ", ").alias("named"))
    dense = of_rule.join(F.broadcast(limits), "id").join(named, "id").crossJoin(F.broadcast(words))
    dense = dense.filter((F.col("words") >= LEAST_WORDS) & (F.col("hits") * 1000.0 / F.col("words") > F.col("most")))
    return together(
        finding(hits.filter("kind = 'artefact'"), "G6", "model-artefact", "fail", F.col("id"), "path", context=F.col("hit")),
        finding(listed, "G6", "ai-phrasing", "warn", F.col("id"), "path", context=F.col("hit")),
        finding(vague, "G6", "vague-attribution", "warn", F.col("id"), "path", context=F.col("hit")),
        finding(dense, "G6", "ai-cadence", "warn", F.col("id"), context=F.col("named")),
    )


def citations(analysis: DataFrame, known: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Cited keys that aren't known (if any are), known ones that nothing cites, and cited ones without a pin."""
    cited = rows(analysis, "citations", "path")
    keys = known.select("citekey").distinct()
    some = F.broadcast(keys.limit(1).select(F.lit(True).alias("_some")))
    out = [
        finding(J.missing(cited, keys, "citekey").crossJoin(some), "G7", "citation-unresolved", "fail", F.col("citekey"), "path"),
        finding(J.missing(keys, cited, "citekey"), "G7", "reference-uncited", "warn", F.col("citekey")),
    ]
    if pinned is not None:
        out.append(finding(J.present(cited.select("citekey").distinct(), pinned.filter("not pinned"), "citekey"), "G7", "citation-key-unpinned", "fail", F.col("citekey")))
    return together(*out)


MODEL_NAME = r"(?i)\b(?:chatgpt|gpt-?\d|gemini|copilot|llama|mistral|language model|llm)\b"


def literature(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Ledger entries whose source is missing, whose quote isn't in it, or whose value isn't in the quote; and
    attestations by models or of few words. ``stored``: source_file, text."""
    ledger = entries.filter("quote is not null").join(stored, "source_file", "left")
    found = ledger.filter("text is not null")
    attested = entries.filter("attested_by is not null")
    return together(
        finding(ledger.filter("text is null"), "G7", "literature-source-missing", "fail", F.col("key"), "source_file"),
        finding(found.filter(~X.contains_quote(F.col("text"), F.col("quote"))), "G7", "quote-not-in-source", "fail", F.col("key"), "source_file"),
        finding(found.filter("display is not null").filter(~X.states_value(X.normalise_text(F.col("quote")), X.normalise_text(F.col("display")))), "G7", "value-not-in-quote", "fail", F.col("key"), "source_file"),
        finding(entries.filter("depth = 'abstract-only'"), "G7", "value-from-abstract", "info", F.col("key"), "source_file"),
        finding(attested.filter(F.col("attested_by").rlike(MODEL_NAME)), "G7", "attestation-not-human", "fail", F.col("key")),
        finding(attested.filter(X.is_thin(F.coalesce("statement", F.lit("")))), "G7", "attestation-thin", "warn", F.col("key")),
    )


def consistency(values: DataFrame) -> DataFrame:
    """One quantity under several keys, and keys declared the same that aren't."""
    numeric = values.filter("quoted and value_double is not null and value_type <> 'BOOLEAN' and not label")
    scale = F.pow(F.lit(10.0), 11 - F.floor(F.log10(F.abs("value_double"))))
    key = F.when(F.col("value_double") == 0, F.lit(0.0)).otherwise(F.round(F.col("value_double") * scale) / scale)
    twice = A.duplicate_quantity(numeric, key)
    code = F.when(F.col("n_displays") > 1, "divergent-display").otherwise("duplicate-quantity")
    same = J.declared_pairs(values.select("ref", F.coalesce(F.col("value_double").cast("string"), F.col("value_text")).alias("value"), "display", F.concat_ws(".", "ns", "same_as").alias("_o"), "same_as").withColumn("same_as", F.when(F.col("same_as").isNotNull(), F.col("_o"))), "same_as")
    state = F.when(F.col("state") == "unresolved", "same-as-unresolved").when(F.col("state") == "differs", "declared-same-but-differs").otherwise("declared-same-but-displayed-differently")
    return together(
        finding(twice, "G8", code, F.col("severity"), F.col("quantity").cast("string")),
        finding(same.filter("state <> 'same'"), "G8", state, "fail", F.concat_ws(" = ", "ref", "other")),
    )


def methods(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Analysis files (``path, sha256``) that were added, removed or changed since methods and code agreed."""
    drift = J.snapshot_diff(recorded, current, "path", "sha256").filter("status <> 'same'")
    return finding(drift, "G9", "methods-drift", "fail", F.col("status"), "path")


def figure_reviews(figures: DataFrame, reviews: DataFrame, checks: DataFrame) -> DataFrame:
    """Figures (``figure, sha256``) without review, with an old one, or with checks that weren't made or failed.
    ``reviews``: figure, content_sha256, checks array<struct<id, ok>>; ``checks``: the ids that a review needs."""
    both = figures.join(reviews, "figure", "left")
    done = reviews.select("figure", F.inline("checks"))
    wanted = reviews.select("figure").crossJoin(F.broadcast(checks.select("id")))
    return together(
        finding(both.filter("content_sha256 is null"), "G10", "figure-unreviewed", "fail", F.col("figure")),
        finding(both.filter("content_sha256 <> sha256"), "G10", "figure-review-stale", "fail", F.col("figure")),
        finding(J.missing(wanted, done, "figure", "id"), "G10", "figure-review-incomplete", "fail", F.concat_ws(" ", "figure", "id")),
        finding(done.filter("not ok"), "G10", "figure-review-check-failed", "fail", F.concat_ws(" ", "figure", "id")),
    )


def reviews(panel: DataFrame, records: DataFrame, files: DataFrame, severity: str = "warn") -> DataFrame:
    """Reviewers without record or twice in a panel, records of files that changed, files that nobody read, and
    major findings that are open. ``panel``: round, id; ``records``: round, reviewer, file_sha256 map, findings array."""
    missing = panel.join(records.select("round", F.col("reviewer").alias("id")), ["round", "id"], "left_anti")
    twice = panel.groupBy("round", "id").count().filter("count > 1")
    read = records.select("round", "reviewer", F.explode("file_sha256").alias("path", "_then"))
    stale = read.join(files.select("path", F.col("sha256").alias("_now")), "path", "left").filter("not (_then <=> _now)")
    rounds = records.select("round").distinct()
    # a record without a list of files read everything, so its round has nothing unread
    whole = records.filter(F.coalesce(F.size("file_sha256"), F.lit(0)) <= 0).select("round").distinct()
    rounds = rounds.join(whole, "round", "left_anti")
    unread = files.select("path").crossJoin(F.broadcast(rounds)).join(read.select("round", "path"), ["round", "path"], "left_anti")
    opened = records.select("round", "reviewer", F.inline("findings")).filter("severity = 'major' and resolution is null")
    who = F.concat_ws(" ", F.col("round").cast("string"), "reviewer")
    return together(
        finding(missing, "G11", "review-missing", severity, F.concat_ws(" ", F.col("round").cast("string"), "id")),
        finding(twice, "G11", "duplicate-reviewer", severity, F.col("id")),
        finding(stale, "G11", "review-stale", severity, who, "path"),
        finding(unread, "G11", "review-uncovered", severity, F.col("round").cast("string"), "path"),
        finding(opened, "G11", "open-major-finding", severity, who),
    )


PLAN_SECTIONS = ("question", "design", "population", "exposure", "outcome", "analysis", "sensitivity")


def plan(sections: DataFrame) -> DataFrame:
    """Sections of the analysis plan (``title, body``) that are missing or empty."""
    wanted = sections.sparkSession.createDataFrame([(s,) for s in PLAN_SECTIONS], "section string")
    both = wanted.join(sections, F.lower("title").contains(F.col("section")), "left")
    empty = F.lower(F.trim(F.coalesce("body", F.lit("")))).isin("", "tbd", "todo", "n/a", "-", "...")
    return together(
        finding(both.filter("title is null"), "G12", "plan-section-missing", "warn", F.col("section")),
        finding(both.filter(F.col("title").isNotNull() & empty), "G12", "plan-section-empty", "warn", F.col("section")),
    )


def revision(points: DataFrame, submitted: DataFrame, current: DataFrame, severity: str = "warn", known: DataFrame | None = None) -> DataFrame:
    """Points without answer, answers that claim nothing, and claimed changes of files (``path, sha256``) that are
    as they were submitted, or of which nobody knows how they were. Of other kinds (results, figure, analysis) ``known``
    (``kind, name``) tells what there is. ``points``: id, response, rebutted, changed array<struct<kind, name>>."""
    said = F.coalesce(F.length(F.trim("response")), F.lit(0)) > 0
    each = points.select("id", F.inline("changed"))
    claims = each.filter("kind = 'file'").withColumnRenamed("name", "path")
    then, now = submitted.select("path", F.col("sha256").alias("_then")), current.select("path", F.col("sha256").alias("_now"))
    idle = claims.join(then, "path", "left").join(now, "path", "left").filter("_now is null or _then is null or _then <=> _now")
    none = F.coalesce(F.size("changed"), F.lit(0)) <= 0
    out = [
        finding(points.filter(~said), "G13", "point-unanswered", severity, F.col("id")),
        finding(points.filter(said & none & ~F.coalesce("rebutted", F.lit(False))), "G13", "response-claims-nothing", severity, F.col("id")),
        finding(idle, "G13", "claimed-change-did-not-happen", severity, F.col("id"), "path"),
    ]
    if known is not None:
        out.append(finding(J.missing(each.filter("kind <> 'file'"), known, "kind", "name"), "G13", "claimed-change-did-not-happen", severity, F.col("id"), "name"))
    return together(*out)


def anchored(points: DataFrame, submitted: DataFrame, current: DataFrame, severity: str = "warn") -> DataFrame:
    """Points that are attached to a paragraph and claim a revision, where that paragraph is as it was submitted or
    is gone. ``points``: id, paragraph, changed; paragraphs: ``paragraph, sha256``. Unknown anchors say nothing."""
    claims = points.filter(F.exists("changed", lambda c: c["kind"] == "file")).select("id", "paragraph")
    then, now = submitted.select("paragraph", F.col("sha256").alias("_then")), current.select("paragraph", F.col("sha256").alias("_now"))
    both = claims.join(then, "paragraph").join(now, "paragraph", "left")
    said = F.when(F.col("_now").isNull(), F.concat(F.col("paragraph"), F.lit(" is gone"))).otherwise(F.concat(F.col("paragraph"), F.lit(" is unchanged")))
    return finding(both.filter("_now is null or _then = _now"), "G13", "claimed-change-did-not-happen", severity, F.concat_ws(": ", "id", said))


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """Values of a second run (``ref, value_double, display``) against the published ones; NaN equals NaN."""
    d = J.snapshot_diff(before, after, "ref", "value_double", "display").filter("status <> 'same'")
    code = F.when(F.col("status") == "changed", "rerun-differs").when(F.col("status") == "removed", "rerun-missing-value").otherwise("rerun-extra-value")
    return finding(d, "VERIFY", code, F.when(F.col("status") == "added", "warn").otherwise("fail"), F.col("ref"))


def audit(analysis: DataFrame, backing: DataFrame) -> DataFrame:
    """Each loose number of unbound documents with whether output files have it; compounds need all their parts."""
    from claimtrace.functions.display import repr_number

    @F.pandas_udf("array<string>")
    def canonical(found):
        import pandas as pd

        return pd.Series([[repr_number(x) for x in xs] for xs in found], dtype=object)

    loose = rows(analysis, "atoms", "path").filter("kind = 'unclassified'").select("path", "start", "line", "atom")
    parts = canonical(F.regexp_extract_all("atom", F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)))
    each = loose.withColumn("number", F.explode(parts)).join(backing.withColumn("_hit", F.lit(True)), "number", "left")
    return each.groupBy("path", "start", "line", "atom").agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("matched"))


def staged(findings: DataFrame, here: str) -> DataFrame:
    """Stage policy: failures that aren't due yet become notes."""
    binds = findings.sparkSession.createDataFrame([(c, s) for s, codes in BINDS.items() for c in codes], "code string, due string")
    return A.deferred(findings, binds, here)


def report(findings: DataFrame) -> DataFrame:
    """Findings in reading order: ``n`` counts over all, by ranges, so that no task has to hold them all."""
    rank = F.expr("array_position(array('fail','warn','info'), severity)")
    placed = findings.withColumn("_rank", rank).withColumn("_line", F.coalesce("line", F.lit(0)))
    return W.ranked(placed, ["_rank", "path", "_line", "code", "message"], "n").drop("_rank", "_line")
