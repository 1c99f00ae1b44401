"""Quality by importance resampling.

Two generative models over hashed words and word pairs, one of target texts and one of all raw texts, give each
document a weight: how much likelier its n-grams are in the target. Documents are then drawn without replacement in
proportion to the weights, by the largest of log weight plus Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.llm.common import cut, mix64, unit, whole

BUCKETS = 1 << 15
#: Distinct words whose hashes a Python worker keeps.
KEPT = 600_000
#: N-grams are counted in blocks of so many words, so long texts take no more memory.
BLOCK = 1 << 16


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """The buckets of a whole text's words and word pairs, in blocks."""
    words = text.lower().split()
    for i in range(0, len(words), BLOCK):
        h = np.array(list(map(_hashes.__getitem__, words[i : i + BLOCK + 1])), dtype=np.uint64)
        own = h[: min(BLOCK, len(words) - i)]
        yield (own % np.uint64(BUCKETS)).astype(np.int64)
        if len(h) > 1:
            with np.errstate(over="ignore"):
                pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
            yield (pairs % np.uint64(BUCKETS)).astype(np.int64)


def ngram_counts(docs: DataFrame, target: Column, text: str = "text") -> DataFrame:
    """``bucket, raw, target``: n-grams of all texts, and of those where ``target`` holds. One row per bucket.

    Each task sums up its own texts first, so what is shuffled is BUCKETS rows per task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for t, is_target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for b in buckets_of(t):
                    c = np.bincount(b, minlength=BUCKETS) if len(b) > BUCKETS else None
                    for sums in (raw, aim) if is_target else (raw,):
                        if c is None:
                            np.add.at(sums, b, 1)
                        else:
                            sums += c
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": at, "raw": raw[at], "target": aim[at]})

    sums = docs.select(whole(text).alias("t"), F.coalesce(target, F.lit(False)).alias("y")).mapInArrow(count, "bucket long, raw long, target long")
    return sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: pd.DataFrame, smooth: float) -> np.ndarray:
    """For each bucket the logarithm of target over raw probability, with ``smooth`` n-grams added to each bucket."""
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], aim[counts["bucket"]] = counts["raw"], counts["target"]
    p, q = (aim + smooth) / (aim + smooth).sum(), (raw + smooth) / (raw + smooth).sum()
    return np.log(p / q)


def ordered_bits(value: Column, lowest: float, highest: float) -> Column:
    """Doubles between two bounds as 48-bit integers in the same order."""
    return F.floor((value - lowest) / (highest - lowest) * F.lit(float(2**48 - 1))).cast("long")


def threshold(keys: DataFrame, name: str, k: int) -> int:
    """The k-th largest of a column of 48-bit integers: counts by their upper 16 bits, and then, only within the one
    in which the k-th lies, by the next ones. 65,536 counts at most come to the driver at once."""
    prefix, left = 0, k
    for shift in (32, 16, 0):
        inside = keys.filter(F.shiftright(name, shift + 16) == prefix)
        counts = inside.groupBy(F.shiftright(name, shift).alias("b")).count().collect()
        for b, n in sorted(((r["b"], r["count"]) for r in counts), reverse=True):
            if n >= left:
                prefix = b
                break
            left -= n
    return prefix


def resampled(docs: DataFrame, target: Column, share: float, seed: int, smooth: float = 1.0, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_grams, log_weight, key, kept``.

    ``log_weight`` is the logarithm of the importance weight, how much likelier the whole text is under the target's
    model than under that of all raw texts: the sum of its n-grams' log ratios. ``key`` adds Gumbel noise from a hash of
    id and text, so the largest keys are a draw without replacement in proportion to the weights. The ``share`` of documents with the largest keys
    is kept; documents that tie with the last of them, such as repeated rows, are kept too. Each text is read twice, for
    the counts and for its weight: a table of every document's buckets would be about as large as the texts. Null texts count as empty
    ones, with no n-grams and weight 0. An empty table gives an empty one; other columns are left out.
    """
    ratios = log_ratios(ngram_counts(docs, target, text).toPandas(), smooth)  # BUCKETS rows at most
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("n_grams long, log_weight double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for texts in batches:
            rows = []
            for t in texts:
                n, total = 0, 0.0
                for b in buckets_of(t):
                    n, total = n + len(b), total + float(of[b].sum())
                rows.append((n, total))
            yield pd.DataFrame(rows, columns=["n_grams", "log_weight"])

    @F.pandas_udf("double")
    def gumbel(h: pd.Series) -> pd.Series:
        return pd.Series(-np.log(-np.log(unit(mix64(h.to_numpy().view(np.uint64))))))

    noise = gumbel(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), whole(text)))
    rows = docs.select("doc_id", weigh(whole(text)).alias("_w"), noise.alias("_g")).select("doc_id", "_w.*", "_g")
    rows = cut(rows.withColumn("key", F.col("log_weight") + F.col("_g")).drop("_g"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    k = round(n * share)
    if not k or low == high:
        return rows.withColumn("kept", F.lit(bool(k)))
    rows = rows.withColumn("_bits", ordered_bits(F.col("key"), low, high))
    return rows.withColumn("kept", F.col("_bits") >= threshold(rows, "_bits", k)).drop("_bits")
