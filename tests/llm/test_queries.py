"""The registered corpus queries at the smallest scale: equal to their SQL, or one row per input row."""

import pytest
from oracle import assert_same, connect

from millrace.llm import queries

SMALL = "/root/testdata/sf0.001"
TABLES = {"op8_warc": "pages", "op9_embedding_dedup": "embeddings"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    if name in queries.ORACLE_SQL:
        assert_same(df, duck, queries.ORACLE_SQL[name])
    else:
        assert df.count() == spark.read.parquet(f"{SMALL}/{TABLES.get(name, 'documents')}.parquet").count()
