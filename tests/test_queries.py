"""Each registered query against its SQL on the smallest tables. Those without SQL are in test_brute.py; the llm ones in tests/llm."""

import pytest

from lorelake.plans.oracle import ORACLE
from lorelake.plans.queries import QUERIES

from .compare import DATA, assert_like_sql, duck_views, no_tables
from .test_brute import BRUTE

pytestmark = no_tables


@pytest.fixture(scope="module")
def duck():
    return duck_views(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    assert_like_sql(QUERIES[name](spark, DATA), duck, ORACLE[name])


def test_every_query_is_compared():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE) | set(BRUTE)
