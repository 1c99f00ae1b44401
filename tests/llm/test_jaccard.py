"""Near copies of the pipeline's dedup stage against brute-force Jaccard over all pairs."""

import random

import corpus_pipeline as C
import pandas as pd
import pytest
from claimtrace.llm import jaccard
from pyspark.sql import functions as F

TESTDATA = "/root/testdata"


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_stay(rows):
    """The smallest id, then text hash aside, of each group of texts that Jaccard 0.8 joins."""
    texts = sorted({t for _, t in rows})
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, t in rows:
        r = find(texts.index(t))
        least[r] = min(least.get(r, i), i)
    return sorted(least.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_dedup_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{TESTDATA}/{sf}/documents.parquet")
    rows = docs.toPandas()
    got = C.dedup(spark, docs, "").toPandas()
    assert list(got.columns) == list(rows.columns)
    assert sorted(got.doc_id) == brute_stay(list(zip(rows.doc_id, rows.text.fillna(""), strict=True)))


def test_edited_copies_and_clouds(spark):
    """Copies with single words changed, a dense cloud of them, texts of few words, and none."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(1, " ".join(base))]
    for i in range(2, 80):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 7)):
            words[at] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(words)))
    rows += [(100, "A b c"), (101, "a  B c"), (102, ""), (103, " "), (104, "a b d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.representatives(docs).collect()) == brute_stay(rows)
    assert jaccard.representatives(docs.limit(0)).count() == 0
    assert pd.Series([r.doc_id for r in jaccard.representatives(docs.union(docs)).collect()]).is_unique


def test_texts_near_one_hub_make_few_pairs(spark, monkeypatch):
    """A cloud around one text, many of whose texts aren't linked to it: what they lack of it rules pairs out."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for at in rng.sample(range(150), 3 if i % 2 else 4):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    made, verified = [], jaccard._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.representatives(docs).collect()) == brute_stay(rows)
    assert made[-1] < 400


def test_dedup_links_by_fingerprints(spark, monkeypatch):
    """Where no bands meet, texts whose fingerprints operator 5 links are joined, if they are similar; others aren't."""
    rng = random.Random(11)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(9000)}" for _ in range(900)]
        rows += [(10 * i + 1, " ".join(words)), (10 * i + 2, " ".join(words).upper()), (10 * i + 3, " ".join([*words[:-1], "other"]))]
    sizes = []
    sketch = jaccard._sketch
    monkeypatch.setattr(jaccard, "_sketch", lambda text, width: sketch(text, width).withField("bands", F.array().cast("array<long>")))
    monkeypatch.setattr(jaccard, "spanning", lambda nodes, *rest, f=getattr(jaccard, "spanning", None): sizes.append(nodes.count()) or f(nodes, *rest), raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.representatives(docs).collect()) == [10 * i + 1 for i in range(12)] == brute_stay(rows)
    assert len(sizes) == 1
