import os

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import oracles, registry
from tests.test_oracles import TABLES, plain

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    assert plain(registry.queries()[name](spark, DATA).toPandas()) == plain(duck.sql(oracles.ORACLES[name]).df())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert mixed.columns == [*columns, "copies"] and mixed.where("copies < 1 or copies > 2").count() == 0
