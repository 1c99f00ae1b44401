"""The order of findings, over all rows."""

import pandas as pd
from claimtrace import queries as Q

SF = "/root/testdata/sf0.001"


def test_all_findings_are_ranked(spark):
    talk = pd.read_parquet(f"{SF}/conversations.parquet")
    rank = {"system": 0, "user": 1}
    want = sorted((rank.get(r, 2), c, n) for r, c, n in zip(talk.role, talk.conv_id, talk.turn, strict=True))
    got = sorted(Q.QUERIES["t1_findings_order"](spark, SF).toPandas()[["position_rank", "conv_id", "turn"]].itertuples(index=False, name=None))
    assert got == [(i, c, n) for i, (_, c, n) in enumerate(want, 1)]
