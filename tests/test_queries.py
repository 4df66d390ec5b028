import pytest

import __spark_entry__ as entry
from oracle import expected, found
from tessera.plans import queries as retrieval


@pytest.mark.parametrize("name", sorted(retrieval.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert found(entry.queries()[name](spark, sf)) == expected(entry.oracle_sql()[name], sf)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_has_sql():
    assert set(retrieval.QUERIES) == set(retrieval.ORACLES)
