import math
import os

import duckdb
import pytest
from claimtrace import gate_queries  # noqa: F401  (registers its queries)
from claimtrace import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = db.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = plain(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() >= 0 and set(Q.QUERIES) <= set(E.queries())
