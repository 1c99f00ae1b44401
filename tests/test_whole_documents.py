"""The analyser's queries over whole texts: a fixture of odd markup with what is in it, and the numbers of real texts."""

import re
from collections import Counter

import pandas as pd
from claimtrace import queries as Q

SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, "# One\nWe saw 12 of 3,400 [@a1].\n\n## Two\n{{results.n}} and {{ bad }}\n~~~r\nx = 5\n~~~\n"),
    (2, None), (3, ""), (4, "``` \nnever closed 7\n<!-- 8 -->"), (5, "word " * 5000 + "99 end"),
]


def test_odd_markup(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect()))
    assert rows("b4_fences_whole") == [(1, "r", 6)]
    assert rows("b7_bindings_whole") == [(1, "", "", False, 5), (1, "results", "n", True, 5)]
    assert rows("b12_headings_whole") == [(1, 1, "One", "One"), (1, 2, "Two", "One > Two")]
    assert rows("b16_citations_whole") == [(1, "a1", False)]
    assert [(i, a) for i, a, *_ in rows("c8_classified_atoms")] == [(1, "12"), (1, "3,400"), (4, "7"), (5, "99")]
    assert sum(r[-1] for r in rows("e2_exemptions")) == 4
    codes = {code: n for _, code, _, n in rows("g2_numbers_gate")}
    assert codes["malformed-placeholder"] == codes["unresolved-binding"] == 1


def test_numbers_of_real_texts(spark):
    """Runs of digits between spaces are atoms, wherever no markup can hide them."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = Counter((r.doc_id, r.atom) for r in Q.QUERIES["c8_classified_atoms"](spark, SF).collect())
    plain = docs[~docs.text.fillna("").str.contains(r"[<`~{}@\\[\\]]|^---|https?:|doi", regex=True)]
    want = Counter((i, a) for i, x in zip(plain.doc_id, plain.text.fillna(""), strict=True) for a in re.findall(r"(?<!\S)[0-9]+(?!\S)", x))
    assert want and all(got[k] >= n for k, n in want.items())
