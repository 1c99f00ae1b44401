"""Copies that the mix took are segmented each in its own way."""

import corpus_pipeline as C


def test_copies_get_segmentations_of_their_own(spark):
    rows = [(1, "s", "the onlyre hation of the lattice")] * 3 + [(2, "s", "another text")] + [(3, "s", "")] * 2 + [(4, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = C.segment(spark, docs, "").toPandas()
    assert sorted(got.doc_id) == [1, 1, 1, 2, 3, 3, 4] and got.exact.all()
    assert got[got.doc_id == 1].pieces.map(bytes).nunique() == 3
