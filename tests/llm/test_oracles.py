"""The operators that SQL can express, against it, on the smallest tables."""

import os

import pytest

from lagoon.llm import queries
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None
