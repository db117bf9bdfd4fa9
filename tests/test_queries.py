"""Every library query against its SQL on the smallest tables; those without SQL run and keep their schema."""

import pytest

from compare import connect, differences
from wayfare import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert differences(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
