"""Every registered core query against its SQL over the whole of the small tables."""

import pytest

from lorespark import registry
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    if name in registry.ORACLE:
        same(df, duck, registry.ORACLE[name])
    else:
        assert df.count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
