"""Every registered core query against its SQL at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from millrace import oracles, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(frame):
    def one(v):
        if pd.isna(v):
            return "NULL"
        return str(v) if isinstance(v, str) else f"{float(v):.9g}" if not isinstance(v, bool) and hasattr(v, "__float__") else str(bool(v))

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(oracles.ORACLES[name]).df())
