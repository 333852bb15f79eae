"""Every query that has SQL against that SQL."""

import pytest

from sievemark.plans.all import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
