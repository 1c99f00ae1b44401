"""An id with several texts stands for each group that one of them is in."""

import pytest
from claimtrace.llm import jaccard, simhash


@pytest.mark.parametrize("representatives", [simhash.representatives, jaccard.representatives])
def test_an_id_stands_for_each_of_its_groups(spark, representatives):
    x, y = (" ".join(f"{c}{i}" for i in range(400)) for c in "xy")
    docs = spark.createDataFrame([(1, x), (1, y), (5, y.replace("y399", "z")), (5, y)], "doc_id long, text string")
    got = sorted(tuple(r) for r in representatives(docs).collect())
    assert got == [(1, x), (1, y)]
