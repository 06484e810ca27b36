"""Every query with a SQL twin gives the same rows in DuckDB; the others run."""

import pytest
from conftest import DATA, oracle_rows, rows_of

from spanloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    if name not in registry.ORACLE_SQL:
        assert df.count() >= 0
        return
    columns, expected = oracle_rows(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
