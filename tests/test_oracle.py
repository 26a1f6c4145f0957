"""Every registered query against its SQL on the smallest tables."""

import pytest

import compare
from tidemill.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(con, name, QUERIES[name](spark, FOLDER), ORACLES[name]) is None
