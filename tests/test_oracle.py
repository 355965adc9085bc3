"""Every query against its SQL in DuckDB."""

import pytest

from lattica.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query(spark, duck, small, key):
    got, want = QUERIES[key](spark, small).toPandas(), duck.execute(ORACLE_SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
