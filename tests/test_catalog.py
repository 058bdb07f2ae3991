import pytest

from tests.conftest import SMALL
from tickloom.plans import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_duckdb(spark, duck, same, name):
    got = catalog.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got) == same(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
