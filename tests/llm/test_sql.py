"""Queries that SQL expresses, over whole tables."""

import pytest
from compare import assert_equal

from quarry.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", SQL)
def test_like_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert_equal(QUERIES[name](spark, sf_dir), sf_dir, SQL[name])
