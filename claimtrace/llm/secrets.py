"""Secret scans by a trigram inverted index.

Each rule's regex is read for the trigrams that its matches can't lack; they form a Boolean query, an OR of ANDs. The
index tells for each query trigram which texts have it. It is kept beside the texts, as words of one bit per posting
list, so intersecting lists is an AND on words of the same row: no text and no id is shuffled, whatever the number of
candidates. ``postings`` gives the same index as lists. Only candidates are searched with a rule's regex; rules without
mandatory trigrams search all. Everything is DataFrame operations.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.llm.common import unused, whole

#: So many strings or clauses at most are followed through a regex; beyond, a query is cut short and stays a superset.
MOST = 64
#: Posting lists per word of the index.
BITS = 62
#: Arrays are grown in chunks of so many elements, so that long ones aren't copied for each element.
CHUNK = 128
#: Texts are cut into blocks of so many code points before pieces are taken from them.
BLOCK = 512

Clauses = list[frozenset]


@dataclass(frozen=True)
class Rule:
    """Matches of ``regex``, leftmost and non-overlapping, with ``least`` characters or more in ``group``."""

    kind: str
    regex: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.regex


#: For the last two, asking for the length in the regex finds the same as dropping short matches, and faster: a run
#: that starts too late to be long enough has no longer one inside.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)


def _trigrams(strings: set[str]) -> Clauses:
    return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]


def _both(a: Clauses, b: Clauses) -> Clauses:
    """Of two queries that both hold: their conjunction, or the first where that has too many clauses."""
    return [x | y for x in a for y in b] if len(a) * len(b) <= MOST else a


def _read(nodes) -> tuple[set[str] | None, Clauses]:
    """The strings that a sequence of regex nodes can match if they are few, and a query that all matches fulfil."""
    exact, query, whole_run = {""}, [frozenset()], True

    def close() -> None:
        nonlocal exact, query, whole_run
        query, exact, whole_run = _both(query, _trigrams(exact)), {""}, False

    for op, arg in nodes:
        strings, holds = None, [frozenset()]
        if op is sre.LITERAL:
            strings = {chr(arg)}
        elif op is sre.IN and arg[0][0] is not sre.NEGATE and all(x[0] in (sre.LITERAL, sre.RANGE) for x in arg):
            chars = {chr(c) for kind, x in arg for c in ([x] if kind is sre.LITERAL else range(x[0], x[1] + 1))}
            strings = chars if len(chars) <= 4 else None
        elif op is sre.SUBPATTERN:
            strings, holds = _read(arg[-1])
        elif op is sre.BRANCH:
            read = [_read(x) for x in arg[1]]
            if all(s is not None for s, _ in read):
                strings = set().union(*(s for s, _ in read))
            else:
                holds = [c for _, q in read for c in q]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            s, q = _read(inner)
            if (low, high) == (0, 1) and s is not None:
                strings = s | {""}
            elif low:
                holds = q
        elif op is sre.AT:
            continue
        if strings is not None and len(exact) * len(strings) <= MOST:
            exact = {a + b for a in exact for b in strings}
        else:
            close()
            query = _both(query, holds if strings is None else _trigrams(strings))
    complete = exact if whole_run else None
    close()
    return complete, query


def trigram_query(rule: Rule) -> Clauses:
    """Clauses of trigrams, one of which is whole in the text of each match; none: the rule searches all texts."""
    _, clauses = _read(sre_parser.parse(rule.regex))
    if rule.ignore_case:
        clauses = [frozenset(t.lower() for t in c) for c in clauses]
    clauses = set(clauses)
    least = [c for c in clauses if not any(d < c for d in clauses)]
    return [] if frozenset() in clauses else sorted(least, key=sorted)


def terms(rules: tuple[Rule, ...]) -> list[tuple[str, bool]]:
    """The index's terms: a trigram, and whether it is looked for in the lower-cased text."""
    return sorted({(t, r.ignore_case) for r in rules for c in trigram_query(r) for t in c})


def index_words(rules: tuple[Rule, ...], text: str = "text") -> list[Column]:
    """The index's entry of a text: words of BITS bits, the i-th of which tells whether it has term i."""
    body, low = whole(text), F.lower(whole(text))
    has = [(low if fold else body).contains(t) for t, fold in terms(rules)]
    bit = lambda x, i: F.when(x, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return [reduce(lambda a, b: a.bitwiseOR(b), (bit(x, i) for i, x in enumerate(has[n : n + BITS]))) for n in range(0, len(has), BITS)]


def postings(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """The inverted index as lists: ``term, doc_id``, which texts have which trigram."""
    (words,) = unused(docs, "_words")
    listed = docs.withColumn(words, F.array(*index_words(rules, text)).cast("array<long>")).select("doc_id", F.posexplode(words).alias("_w", "_bits"))
    each = F.array(*(F.when(F.col("_bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col("_w") * BITS + i) for i in range(BITS)))
    listed = listed.select("doc_id", F.explode(F.array_compact(each)).alias("_i"))
    names = F.array(*(F.lit(t) for t, _ in terms(rules))).cast("array<string>")
    return listed.select(F.get(names, F.col("_i")).alias("term"), "doc_id")


def fulfils(rule: Rule, rules: tuple[Rule, ...], words: list[Column]) -> Column:
    """Whether a text whose index entry is ``words`` is a candidate of ``rule``: in all the lists of one of its clauses."""
    number = {t: i for i, t in enumerate(terms(rules))}
    clauses = []
    for c in trigram_query(rule):
        need: dict[int, int] = {}
        for t in c:
            i = number[t, rule.ignore_case]
            need[i // BITS] = need.get(i // BITS, 0) | 1 << i % BITS
        clauses.append(reduce(lambda a, b: a & b, (words[w].bitwiseAND(F.lit(n).cast("long")) == F.lit(n) for w, n in need.items())))
    return reduce(lambda a, b: a | b, clauses) if clauses else F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(array: Column, at: int, kind: str, one: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A fold that carries a number ``at`` and grows an array ``out`` of ``kind``, in chunks, so in about linear time.

    ``one`` gives for what is carried and an element the new number and the array of what is added (often empty).
    """
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        now, new = one(acc, x)
        return F.struct(now.alias("at"), F.concat(acc["out"], new).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def folded(x: Column) -> Column:
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.slice(x, i, CHUNK))
        start = F.struct(F.lit(at).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(parts, start, chunk, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))

    return _let(array, folded)


SPAN = "struct<start:int,rule:int,end:int>"


def _spans(rule: Rule, k: int, body: Column) -> Column:
    """``start, rule, end`` of a rule's matches in code points: what lies between them and they themselves, summed up."""
    regex = F.lit(rule.java)
    found, kept = F.regexp_extract_all(body, regex, F.lit(0)), F.regexp_extract_all(body, regex, F.lit(rule.group))
    lengths = _let(found, lambda hits: F.transform(
        F.arrays_zip(F.slice(F.split(body, rule.java, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), kept.alias("kept")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["kept"]) >= rule.least).alias("good")),
    ))

    def one(acc: Column, x: Column) -> tuple[Column, Column]:
        end = acc["at"] + x["gap"] + x["hit"]
        span = F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(k).alias("rule"), end.alias("end"))
        return end, F.when(x["good"], F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _fold(lengths, 0, SPAN, one)["out"]


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: ``start, rule, end`` of every secret, by start, then rule.

    Positions are code points, ends are exclusive, rules count from 0. Null texts have no spans, like empty ones.
    Repeated rows and rows without an id are rows like others; spans of a text are found in time that grows with its
    length. An input column named ``secret_spans`` is replaced; an empty table gives an empty one.
    """
    docs = docs.drop("secret_spans")
    entry = index_words(rules, text)
    words = unused(docs, *(f"_word{i}" for i in range(len(entry))))
    body, each = whole(text), []
    for k, r in enumerate(rules):
        searched = fulfils(r, rules, [F.col(w) for w in words]) if trigram_query(r) else F.lit(True)
        each.append(F.when(searched & body.rlike(r.java), _spans(r, k, body)))
    rows = docs.withColumns(dict(zip(words, entry, strict=True)))
    return rows.withColumn("secret_spans", F.array_sort(F.flatten(F.array_compact(F.array(*each))))).drop(*words)


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")


def redacted(body: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of spans that overlap or touch replaced by ``mark``. Spans are sorted by start.

    What stays is taken from blocks of the text, so a long text isn't read from its beginning for each span.
    """
    gap = "struct<start:int,end:int>"

    def one(acc: Column, s: Column) -> tuple[Column, Column]:
        before = F.array(F.struct(F.greatest(acc["at"], F.lit(0)).alias("start"), s["start"].alias("end")))
        return F.greatest(acc["at"], s["end"]), F.when(s["start"] > acc["at"], before).otherwise(F.array().cast(f"array<{gap}>"))

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        some = F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1)
        return F.when(end > start, F.substring(F.array_join(some, ""), start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))

    def text(blocks: Column) -> Column:
        return _let(_fold(spans, -1, gap, one), lambda r: F.concat(
            F.array_join(F.transform(r["out"], lambda g: piece(blocks, g["start"], g["end"])), mark), F.lit(mark), piece(blocks, r["at"], F.length(body))
        ))

    return F.when(F.size(spans) > 0, _let(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), text)).otherwise(body)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One digest row per document: counts by kind, and the spans as text and hash."""
    spans = with_spans(docs, rules).select("doc_id", "secret_spans")
    counts = [_count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules)]
    return spans.withColumn("spans", listed(F.col("secret_spans"), rules)).select("doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


def _count(k: int) -> Column:
    return F.size(F.filter("secret_spans", lambda s: s["rule"] == k)).cast("long")
