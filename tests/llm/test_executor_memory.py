"""Stages don't begin with executors' heaps as large as what ran before has left them."""

import corpus_pipeline as C
import pytest


def collections(spark):
    """Full collections of the JVM, which is the executor's too in a local session."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


@pytest.mark.parametrize("name", ["secrets", "segment"])
def test_stages_without_cuts_collect_garbage_first(spark, name):
    docs = spark.createDataFrame([(1, "s", "the lattice", 11), (2, "s", "another text", 12)], "doc_id long, source string, text string, n_chars int")
    before = collections(spark)
    rows = dict(C.STAGES)[name](spark, docs, "")
    assert collections(spark) > before
    assert sorted(r.doc_id for r in rows.collect()) == [1, 2]
