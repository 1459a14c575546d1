import pytest

from siftgrain.plans.more_queries import QUERIES, SQL
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(name, spark, same):
    same(QUERIES[name](spark, DATA), SQL[name])


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
