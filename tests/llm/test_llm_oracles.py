"""Registered queries of the subpackage against their SQL on the smallest tables."""

import compare
import pytest

from tidemill.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare.differences(compare.connect(FOLDER), name, QUERIES[name](spark, FOLDER), ORACLES[name]) is None
