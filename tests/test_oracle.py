"""Every query with SQL, held against DuckDB at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from tallyrank.plans import oracle, queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{D}/{name}.parquet')")
    return con


def plain(row):
    return repr([v + 0.0 if isinstance(v, float) else v for v in row])


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    want = sorted(plain(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({oracle.SQL[name]})").fetchall())
    assert got == want
