"""Quality rules at host level.

Every document is measured; failures of the rules are summed by host; a host's rate is shrunk to the rate of all
hosts by a beta prior that is fitted to how much hosts differ; and each host's verdict goes back to its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.llm.common import cut, give_back, unused, whole

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
#: Rejected hosts are broadcast up to so many (a name each); beyond, they are joined by a shuffle.
MOST_BROADCAST = 50_000


@dataclass(frozen=True)
class Limits:
    """A document fails below ``words``, or above a percentage of words in repeated windows. It has a lesser failure above
    ``symbols`` per 100 characters of words or ``dup_lines`` per 100 lines. Both count as failures of its host.

    A host is poor if its shrunk rate of failing documents lies above the upper end of the prior, ``deviations`` of its
    standard deviations over its mean (2.33: the highest hundredth); documents of poor hosts go for lesser failures too.
    A host whose shrunk rate is above ``host_rate`` per cent is rejected with all its documents."""

    words: int = 50
    repeat: int = 50
    symbols: int = 10
    dup_lines: int = 30
    deviations: float = 2.33
    host_rate: int = 60


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def measure(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8").split()  # of bytes: at ASCII white space only
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), repeated_words(words)


def measures(text: Column) -> Column:
    @F.pandas_udf(STATS)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STATS.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=names, dtype="int64")
        give_back()

    return measured(text)


def host_verdicts(measured: DataFrame, limits: Limits) -> DataFrame:
    """``host, n_docs, n_failed, rate, poor, rejected`` from documents with ``_host`` and ``_failed``.

    The prior's mean is the rate of all documents. Its weight in documents follows from the spread of hosts' rates
    beyond what chance gives; hosts that differ no more than by chance get the heaviest, 1,000,000 documents.
    """
    hosts = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("_failed").cast("long")).alias("n_failed"))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    over = hosts.agg(F.sum(n).alias("_n"), F.sum(f).alias("_f"), F.sum(n * n).alias("_nn"), F.sum(f * f / n).alias("_ff"), F.count(F.lit(1)).alias("_h"))
    m = F.col("_f") / F.col("_n")
    spread = F.col("_ff") - F.col("_n") * m * m  # the sum of n (rate - mean)^2
    chance, unit = m * (1 - m) * (F.col("_h") - 1), m * (1 - m) * (F.col("_n") - F.col("_nn") / F.col("_n") - (F.col("_h") - 1))
    excess = F.when(unit > 0, (spread - chance) / unit).otherwise(0.0)
    weight = F.least(F.lit(1e6), F.greatest(F.lit(1.0), 1 / F.greatest(excess, F.lit(1e-6)) - 1))
    prior = over.select(m.alias("_mean"), weight.alias("_weight"))  # one row
    rate = (f + F.col("_mean") * F.col("_weight")) / (n + F.col("_weight"))
    upper = F.col("_mean") + F.lit(limits.deviations) * F.sqrt(F.col("_mean") * (1 - F.col("_mean")) / (F.col("_weight") + 1))
    rejected = rate * 100 > limits.host_rate
    return hosts.crossJoin(F.broadcast(prior)).select(F.col("_host").alias("host"), "n_docs", "n_failed", rate.alias("rate"), (rejected | (rate > upper)).alias("poor"), rejected.alias("rejected"))


def _failures(limits: Limits, m: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
    """Whether a measured document fails by itself, and whether it has a lesser failure."""
    short = (m("n_words") < limits.words) | (100 * m("n_repeat_words") > limits.repeat * m("n_words"))
    return short, (100 * m("n_symbols") > limits.symbols * m("word_chars")) | (100 * m("n_dup_lines") > limits.dup_lines * m("n_lines"))


def _judged(docs: DataFrame, limits: Limits, text: str, host: str) -> tuple[DataFrame, DataFrame]:
    """The measured documents without their texts, and the poor hosts as ``_bad, _out`` (whether rejected)."""
    rows = docs.select("doc_id", F.col(host).alias("_host"), measures(whole(text)).alias("_m")).select("doc_id", "_host", "_m.*")
    short, lesser = _failures(limits)
    rows = cut(rows.withColumn("base_failed", short).withColumn("_lesser", lesser).withColumn("_failed", F.col("base_failed") | F.col("_lesser")))
    bad = cut(host_verdicts(rows, limits).filter("poor").select(F.col("host").alias("_bad"), F.col("rejected").alias("_out")))
    return rows, F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad


def judged(docs: DataFrame, limits: Limits | None = None, text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``host_poor``, ``host_rejected`` and ``kept``.

    Null texts are measured as empty ones, and so fail. Documents without a host make up a host of their own.
    Repeated rows are judged alike and all count; an empty table gives an empty one; other columns are left out.
    """
    rows, bad = _judged(docs, limits or Limits(), text, host)
    rows = rows.join(bad, F.col("_host").eqNullSafe(F.col("_bad")), "left")
    rows = rows.withColumn("host_poor", F.col("_out").isNotNull()).withColumn("host_rejected", F.coalesce("_out", F.lit(False)))
    goes = F.col("base_failed") | F.col("host_rejected") | (F.col("host_poor") & F.col("_lesser"))
    return rows.withColumn("kept", ~goes).drop("_bad", "_out", "_failed", "_lesser", "_host")


def kept_documents(docs: DataFrame, limits: Limits | None = None, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that ``judged`` keeps, with the columns of ``docs``.

    Texts are measured a second time in place of shuffling them to their verdicts: hosts' verdicts depend on all texts,
    and the other way would be to store every text once more between the two passes.
    """
    limits = limits or Limits()
    _, bad = _judged(docs, limits, text, host)
    m, name, out = unused(docs, "_m", "_bad", "_out")
    short, lesser = _failures(limits, lambda c: F.col(m)[c])
    rows = docs.withColumn(m, measures(whole(text))).filter(~short)
    rows = rows.join(bad.withColumnsRenamed({"_bad": name, "_out": out}), F.col(host).eqNullSafe(F.col(name)), "left")
    return rows.filter(F.col(out).isNull() | (~F.col(out) & ~lesser)).select(*docs.columns)
