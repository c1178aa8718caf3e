"""Every registered query of the engine against DuckDB on the same tables; those without SQL must run."""

import pytest
from oracle import SF, compare

from quarry import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_like_sql(spark, name):
    compare(spark, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
