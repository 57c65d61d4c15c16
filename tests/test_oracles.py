"""Every registered query that SQL can state, against that SQL."""

import pytest

from lodestone.plans import registry

from .oracle import both, connect

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    mine, theirs = both(spark, con, registry.queries()[name], SQL[name], SF)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "score"]
