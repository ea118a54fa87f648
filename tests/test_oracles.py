"""Every registered query at the smallest scale: equal to its SQL, or at least with rows."""

import pytest
from oracle import assert_same, connect

from millrace.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLE_SQL:
        assert_same(df, duck, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
