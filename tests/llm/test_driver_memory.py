"""Rounds of joins leave no estimates behind that grow."""

from claimtrace.llm.common import cut


def test_estimated_sizes_do_not_grow_over_rounds_of_joins(spark):
    df = cut(spark.range(5).selectExpr("id", "id + 1 as x"))
    for _ in range(4):
        df = cut(df.join(df.select("id"), "id"))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
    assert sorted(map(tuple, df.collect())) == [(i, i + 1) for i in range(5)]
