"""Every engine query against its DuckDB counterpart on the smallest tables."""

import pytest

from shoal.plans import registry

from .compare import duck, same


@pytest.fixture(scope="module")
def db(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, spark, small, db):
    same(registry.QUERIES[name](spark, small), db.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, small):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
