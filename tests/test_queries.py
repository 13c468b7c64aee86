"""Each registered panel query against DuckDB at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from longspan.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    def cell(x):
        return "NULL" if x is None or x is pd.NA or x != x else f"{x + 0:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
