import pytest

from quarrygraph import registry

from .oracle import check, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(name, spark, con, sf):
    check(spark, con, registry.queries()[name], registry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
