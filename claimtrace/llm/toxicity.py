"""Toxicity by a counterfactually regularised classifier.

A logistic model over hashed words and beginnings of words is fitted to labelled texts. Where a labelled sentence
names a group of people, the name is swapped for others of the same kind, and the model is punished for scoring the
two texts differently, so that neutral mentions of a group don't raise the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.llm.common import whole

#: Kinds of group names; a name is swapped for others of its kind.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("women", "men"),
    ("woman", "man"),
    ("mexican", "american", "chinese", "german", "french", "turkish", "indian", "polish"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)

#: Beginnings of words of these lengths are features beside the words themselves.
PREFIXES = (4, 5, 6, 7)
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
#: Distinct words whose features a Python worker keeps.
KEPT = 400_000


@dataclass(frozen=True)
class Training:
    """``sample`` bounds the labelled rows that are learned from, the ``swaps`` of a row and ``features`` the model.
    ``fair`` weighs the score changes under swaps, ``ridge`` the weights."""

    sample: int = 6000
    swaps: int = 3
    features: int = 4000
    least_chi2: float = 24.0
    fair: float = 5.0
    ridge: float = 1e-4
    steps: int = 1000
    rate: float = 0.3
    folds: int = 5
    identities: tuple[tuple[str, ...], ...] = field(default=IDENTITIES)


def features_of(word: str) -> list[int]:
    """A word's features as hashes of 32 bits: the word without marks around it, and its beginnings."""
    word = word.strip(EDGES)
    if not word:
        return []
    parts = ["w " + word, *("p " + word[:n] for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh32_intdigest(p) for p in parts]


def text_features(text: str) -> np.ndarray:
    """The distinct features of a whole text, sorted."""
    return np.array(sorted({f for w in set(text.lower().split()) for f in features_of(w)}), dtype=np.int64)


def swapped(text: str, key: int, training: Training) -> list[str]:
    """Up to ``swaps`` texts in which each sentence that names a group names another of its kind."""
    kind = {name: names for names in training.identities for name in names}
    finder = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, kind), key=len, reverse=True)) + r")\b", re.I)
    sentences = SENTENCE.split(text)
    named = [i for i, s in enumerate(sentences) if finder.search(s)]
    if not named:
        return []
    out = []
    for turn in range(1, training.swaps + 1):

        def other(m: re.Match, turn: int = turn) -> str:
            names = kind[m[0].lower()]
            return names[(names.index(m[0].lower()) + 1 + (key + turn) % (len(names) - 1)) % len(names)]

        changed = list(sentences)
        for i in named:
            changed[i] = finder.sub(other, sentences[i])
        out.append("\n".join(changed))
    return list(dict.fromkeys(out))


class Model:
    """Weights by feature hash. ``known`` maps words that were met before to the places of their weights."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.places = {int(h): i for i, h in enumerate(hashes)}
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[int, ...]] = {}

    def __reduce__(self):
        hashes = np.array(sorted(self.places, key=self.places.get), dtype=np.int64)
        return Model, (hashes, self.weights, self.bias)

    def score(self, text: str) -> float:
        """The probability of label 1 for a whole text; for one without known features what the bias says."""
        known, met = self.known, set()
        for w in set(text.lower().split()):
            at = known.get(w)
            if at is None:
                at = tuple(self.places[f] for f in features_of(w) if f in self.places)
                if len(w) <= 64:
                    if len(known) >= KEPT:
                        known.clear()
                    known[w] = at
            if at:
                met.update(at)
        z = self.bias + sum(self.weights[i] for i in sorted(met))
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def fit(rows: list[tuple[int, np.ndarray, list[np.ndarray]]], training: Training) -> Model:
    """The model for rows of label, features, and features of the swapped texts.

    Features are chosen by how far their use differs from chance between labels; names of groups that occur are kept
    in any case, so that the punishment can act on them.
    """
    labels = np.array([r[0] for r in rows], dtype=np.float64)
    n, positive = len(rows), labels.sum()
    base = (positive + 0.5) / (n + 2)
    bias = float(np.log(base / (1 - base)))
    if not 0 < positive < n:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), bias)
    every, place = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    row_of = np.repeat(np.arange(n), [len(r[1]) for r in rows])
    used = np.bincount(place, minlength=len(every)).astype(np.float64)
    hits = np.bincount(place, weights=labels[row_of], minlength=len(every))
    share = positive / n
    chi2 = (hits - used * share) ** 2 / (used * share * (1 - share)) * n / np.maximum(n - used, 1)
    names = {f for names in training.identities for name in names for f in features_of(name)}
    named = np.isin(every, np.array(sorted(names), dtype=np.int64)) & np.array([any(len(r[2]) for r in rows)])
    good = np.flatnonzero((chi2 >= training.least_chi2) & (used >= 3))
    good = good[np.argsort(-chi2[good], kind="stable")[: training.features]]
    chosen = np.union1d(good, np.flatnonzero(named))
    hashes = every[chosen]
    k = len(hashes)
    if not k:
        return Model(hashes, np.zeros(0), bias)

    def sparse(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = [np.searchsorted(hashes, x[np.isin(x, hashes)]) for x in lists]
        return np.repeat(np.arange(len(at)), list(map(len, at))), np.concatenate(at) if at else np.zeros(0, dtype=np.int64)

    r, c = sparse([x[1] for x in rows])
    pairs = [(x[1], s) for x in rows for s in x[2]]
    pr, pc = sparse([np.concatenate([np.setdiff1d(a, s), np.setdiff1d(s, a)]) for a, s in pairs])
    gained = [np.isin(np.setdiff1d(s, a), hashes).sum() for a, s in pairs]
    sign = np.ones(len(pr))
    ends = np.cumsum(np.bincount(pr, minlength=len(pairs))) if pairs else []
    for end, g in zip(ends, gained, strict=True):
        sign[end - g : end] = -1  # features that only the swapped text has
    w, mw, mb, b = np.zeros(k), np.zeros(k), 0.0, bias
    scale = np.sqrt(np.bincount(c, minlength=k) + 1.0)  # common features get smaller steps
    for step in range(training.steps):
        z = b + np.bincount(r, weights=w[c], minlength=n)
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        grad = np.bincount(c, weights=gap[r], minlength=k) + n * training.ridge * w
        if len(pairs):
            change = np.bincount(pr, weights=sign * w[pc], minlength=len(pairs))
            grad += 2 * training.fair * np.bincount(pc, weights=sign * change[pr], minlength=k)
        near = training.rate / (1 + step / 100)
        mw, mb = 0.8 * mw - near * grad / (scale**2 + n * training.ridge + 4 * training.fair * np.bincount(pc, minlength=k)), 0.8 * mb - near * gap.mean()
        w, b = w + mw / 4, b + mb
    return Model(hashes, w, float(b))


def held_out(folds: int) -> Column:
    """Whether a row is kept from learning; a row without an id always is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, training: Training, text: str = "text") -> Model:
    """The model from a sample of the labelled rows that aren't held out, the ``sample`` first by a hash of the id.

    Only that many rows, of distinct features each, come to the driver. Of several labels of an id the larger counts;
    of several texts the first by hash; rows without label are left out.
    """
    known = labels.filter("toxic is not null").filter(~held_out(training.folds)).groupBy("doc_id").agg(F.max("toxic").alias("_label"))
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.sample)
    rows = docs.select("doc_id", whole(text).alias("_text")).join(F.broadcast(first), "doc_id")

    @F.pandas_udf("own array<long>, swaps array<array<long>>")
    def features(texts: pd.Series) -> pd.DataFrame:
        # which names stand in for a text's own follows from the text alone
        found = [(text_features(t), [text_features(s) for s in swapped(t, xxhash.xxh32_intdigest(t), training)]) for t in texts]
        return pd.DataFrame(found, columns=["own", "swaps"])

    got = rows.select("doc_id", "_label", F.xxhash64("_text").alias("_hash"), features("_text").alias("_f")).groupBy("doc_id").agg(F.min_by(F.struct("_label", "_f", "_hash"), "_hash").alias("_r"))
    learned = sorted(((r["_r"]["_hash"], int(r["_r"]["_label"] > 0), np.array(r["_r"]["_f"]["own"], dtype=np.int64), [np.array(s, dtype=np.int64) for s in r["_r"]["_f"]["swaps"]]) for r in got.toLocalIterator()), key=lambda x: x[:2])
    return fit([x[1:] for x in learned], training)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text.

    Null texts score like empty ones, by the share of label 1. Equal texts score equally. Input columns named like a
    result are replaced; an empty table gives an empty one.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``features`` numbers at most

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.score
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return docs.withColumn("score", score(whole(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
