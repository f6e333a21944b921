"""Every registered query outside the training-data operators against its SQL."""

import pytest
from compare import assert_equal

from quarry.plans import conversations, mechanisms, relational, streams

CASES = [(name, f, m.SQL[name]) for m in (conversations, relational, mechanisms, streams) for name, f in m.QUERIES.items()]


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_query(spark, sf_dir, name, query, sql):
    assert_equal(query(spark, sf_dir), sf_dir, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
