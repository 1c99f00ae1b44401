"""Small tables don't take a task for each of many partitions, nor small graphs rounds of stages."""

import random

import numpy as np
import pytest
from claimtrace.llm import common, graph


def test_partitions_with_next_to_nothing_are_read_together(spark, monkeypatch):
    rows = spark.range(3000).repartition(300, "id").sortWithinPartitions("id")
    few = common.cut(rows)
    assert few.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert few.groupBy("id").count().filter("count = 1").count() == 3000
    assert [r.id for r in few.sortWithinPartitions("id").sort("id").collect()] == list(range(3000))
    joined = few.join(common.cut(spark.range(0, 3000, 2).repartition(300, "id")), "id")
    assert sorted(r.id for r in joined.collect()) == list(range(0, 3000, 2))
    assert common.cut(spark.range(100).repartition(20, "id")).rdd.getNumPartitions() == 20
    monkeypatch.setattr(common, "PART", 8)  # then they are large
    assert common.cut(rows).rdd.getNumPartitions() == 300


@pytest.mark.parametrize("most", [0, 50, 10_000])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "ONE_TASK", most)
    made, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(1) or cut(df))
    rng, ids = random.Random(3), [*map(int, np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 400))]
    edges = [(ids[rng.randrange(400)], ids[rng.randrange(400)]) for _ in range(260)] + list(zip(ids[:60], ids[1:61], strict=True))
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert len(made) == 2 if most == 10_000 else len(made) > 4
