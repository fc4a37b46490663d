"""Each query against its SQL."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("events", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def rows(df):
    def shown(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return str(int(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) and float(x).is_integer() else str(x)

    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_others_give_rows(spark):
    assert all(QUERIES[name](spark, SF).count() for name in set(QUERIES) - set(ORACLES))


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 100 and set(ORACLES) <= set(__spark_entry__.oracle_sql())
