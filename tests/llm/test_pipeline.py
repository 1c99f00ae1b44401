"""Each stage of the pipeline against brute force on what the one before kept."""

import corpus_pipeline as C
import pandas as pd
from pyspark.sql import functions as F
from test_operators import WORD, brute_quality, brute_spans

SF = "/root/testdata/sf0.001"


def brute_shingles(text):
    """The set of five-word shingles, of the whole text where it is shorter."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(C.STAGES)
    assert len(C.STAGES) == 5
    before = docs.toPandas()
    kept = stages["quality"](spark, docs, SF)
    good = [i for i, t in zip(before.doc_id, before.text, strict=True) if (q := brute_quality(t))[0] >= 50 and 100 * q[4] <= 50 * q[0]]
    after = kept.toPandas()
    assert sorted(after.doc_id) == sorted(good) and list(kept.columns) == list(docs.columns)

    one = stages["dedup"](spark, kept, SF)
    sets = {i: brute_shingles(t) for i, t in zip(after.doc_id, after.text, strict=True)}
    stay, seen = [], set()
    for i in sorted(sets):
        if i in seen:
            continue
        stay.append(i)
        todo = [i]
        while todo:
            x = todo.pop()
            near = [j for j in sets if j not in seen and 100 * len(sets[x] & sets[j]) >= 80 * len(sets[x] | sets[j])]
            seen.update(near)
            todo += near
    assert sorted(one.toPandas().doc_id) == stay

    clean = stages["secrets"](spark, one, SF).toPandas()
    texts = after.set_index("doc_id").text
    for r in clean.itertuples(index=False):
        assert (r.text == texts[r.doc_id]) == (not brute_spans(texts[r.doc_id])) and not brute_spans(r.text) and r.n_chars == len(r.text)

    mixed = stages["mix"](spark, spark.createDataFrame(clean), SF)
    assert list(mixed.columns) == list(docs.columns) and mixed.groupBy("doc_id").count().filter("count > 3").isEmpty()
    last = stages["segment"](spark, mixed, SF).toPandas()
    assert last.exact.all() and len(last) == mixed.count()


def test_run_keeps_repeated_rows_once(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = pd.DataFrame({"doc_id": [1, 1, 2, None], "text": [text, text, text, text], "lang": "en", "source": "s", "n_chars": len(text)}).astype({"doc_id": "Int64"})
    rows.to_parquet(tmp_path / "documents.parquet")
    got = C.run(spark, str(tmp_path)).toPandas()
    assert list(got.doc_id) == [1] and got.exact.all()


def test_stages_leave_columns_with_working_names_alone(spark):
    """Whatever a table's other columns are called, what the stages keep of them is what was there."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_uid", "_hash", "_many", "_m", "_bad", "_place", "_source", "_times", "_time", "_rules", "_text", "_key", "threshold", "_copies"]
    kept = docs
    for c in names:
        kept = kept.withColumn(c, F.col("doc_id"))
    for _, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert list(kept.columns) == [*docs.columns, *names]
    rows = kept.toPandas()
    assert len(rows) and all((rows[c] == rows.doc_id).all() for c in names)
