"""Every query against its SQL on the smallest tables; queries without SQL must run and repeat."""

import os

import pytest

from lagoon.plans import catalog
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    assert compare(catalog.queries()[name](spark, SF), db, catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_runs_and_repeats(spark, name):
    first, second = (sorted(map(tuple, catalog.queries()[name](spark, SF).collect()), key=repr) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 28
    assert set(e.oracle_sql()) <= set(e.queries())
