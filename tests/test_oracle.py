"""Every registered query with a twin in SQL gives that twin's rows."""

import pytest

import compare
from tessera.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, sf_dir, name):
    compare.check(spark, con, sf_dir, registry.queries()[name], SQL[name])


def test_rows_of_the_others(spark, sf_dir):
    for name in sorted(set(registry.queries()) - set(SQL)):
        assert registry.queries()[name](spark, sf_dir).count() > 0, name


def test_flagship(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
