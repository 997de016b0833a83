"""Each query against its SQL twin."""

import pytest

from chunkloom.plans import oracles, queries
from compare import same


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same(queries.QUERIES[name](spark, sf_dir), duck, oracles.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_registry():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
