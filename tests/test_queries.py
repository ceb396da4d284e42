import oracle
import pytest

import __spark_entry__ as entry
from tickloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert oracle.compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf) is None


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
