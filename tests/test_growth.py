"""Work that must not grow with pairs, with groups, or with how often an analysis is read."""

import math

import pytest
from claimtrace.gate_queries import f12_remit_carried
from claimtrace.operators import joins as J
from claimtrace.plans import roundtrip as R
from claimtrace.queries import g2_numbers_gate
from claimtrace.text import analyze as T

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_latest_before_against_all_pairs(spark):
    nan, inf = math.nan, math.inf
    marks = [("a", 10.0, 1, "p"), ("a", 10.0, 2, "q"), ("a", -3.0, 3, "r"), ("a", 500.0, 4, "s"), ("b", 0.2, 5, "t"), ("a", nan, 6, "u"), ("a", -inf, 7, "v"), (None, 1.0, 8, "w"), ("a", None, 9, "x")]
    points = [(i, g, x) for i, (g, x) in enumerate((g, x) for g in ("a", "b", None, "c") for x in (-inf, -3.0, -2.9, 10.0, 10.1, 400.0, 501.0, nan, None, 0.2, 0.3))]
    found = J.latest_before(spark.createDataFrame(points, "id int, g string, at double"), spark.createDataFrame(marks, "g string, at double, n int, v string"), "g", "at", "n", "v", 50.0)
    want = {}
    for i, g, x in points:
        fit = [(a, n, v) for h, a, n, v in marks if g is not None and h == g and x is not None and a is not None and a == a and (a < x or x != x)]
        if fit:
            want[i] = max(fit)[2]
    assert {r["id"]: r["before"]["value"] for r in found.collect()} == want


def test_remits_are_carried_without_pairs(spark):
    plan = plan_of(f12_remit_carried(spark, SF))
    assert "s_acctbal" in plan and not any(" < " in line for line in plan.splitlines() if "Join" in line)


def test_moves_look_at_changed_documents_only(spark):
    rows = [(d, f"{d}-{i}", i) for d in ("a", "b", "c") for i in range(4)]
    before = spark.createDataFrame(rows, "doc string, id string, position int")
    after = spark.createDataFrame([(d, x, 9 if d == "b" and i == 0 else i) for d, x, i in rows if (d, i) != ("c", 2)], "doc string, id string, position int")
    found = R.moves(before, after)
    assert [tuple(r) for r in found.collect()] == [("b", "b-0", 0, 3)]
    assert "FlatMapGroupsInPandas" not in plan_of(found) and R.moves(before, before).isEmpty()


def test_the_numbers_gate_reads_documents_once(spark):
    plan = plan_of(g2_numbers_gate(spark, SF))
    assert "ArrowEvalPython" not in plan and "parquet" not in plan


@pytest.mark.parametrize("text", ["plain words only\n", "---\ntitle: A 5\nx: 7\n---\n```py\n3\n```\n<!-- 4\n5 --> <!-- {{results.a}} [a](b7) @k9 12 mg"])
def test_masks_keep_places(text):
    masked, spans = T.masked_spans(text)
    assert len(masked) == len(text) and masked.count("\n") == text.count("\n")
    assert all(set(masked[a:b]) <= {"\0", "\n"} for _, a, b in spans)
