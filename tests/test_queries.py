"""Every query of the library against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as contract
from compare import difference, duck
from spendframe.plans.oracles import ORACLES
from spendframe.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tables(data):
    return duck(data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, data, tables):
    assert difference(QUERIES[name](spark, data), tables, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
