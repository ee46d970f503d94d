"""Every registered query equals its DuckDB twin (names, rows, exact values)."""

import pytest

import __spark_entry__ as E
from helpers import rows_of, rows_of_sql
from tally.plans import oracle, queries

QUERIES = queries.build()
SQL = oracle.build()


def test_every_query_has_an_oracle_or_is_listed():
    without = sorted(set(QUERIES) - set(SQL))
    assert without == []
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    expected, cols = rows_of_sql(duck, SQL[name])
    assert sorted(df.columns) == cols
    assert rows_of(df) == expected


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["period", "inflow", "outflow", "net_flow", "running_balance",
                          "transaction_count"]
