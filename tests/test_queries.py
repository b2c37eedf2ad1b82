"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import pytest

from gridquarry.plans.queries import ORACLE_SQL, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    compare(spark, SF, QUERIES[name], ORACLE_SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
