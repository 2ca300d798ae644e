"""Every registered query against its DuckDB twin (row count, column
names, order-insensitive value hash), like the driver's check."""

import pytest

from conftest import SF_SMALL
from webtide.oracle.harness import compare, duck_connect
from webtide.plans.registry import all_oracle_sql, all_queries

QUERIES = all_queries()
ORACLE = all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF_SMALL), ORACLE[name], con)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert "body" in df.columns and "word_count" in df.columns
