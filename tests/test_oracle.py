"""Every query with SQL agrees with it on the smallest tables."""

import pytest

from tests.conftest import DATA, same
from threadbook.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    same(QUERIES[name](spark, f"{DATA}/sf0.001"), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
