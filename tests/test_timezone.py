"""Date semantics do not depend on the session time zone."""

import pytest

import __spark_entry__ as E
from helpers import rows_of, rows_of_sql

NAMES = ["stream_cash_flow_daily", "cash_flow_weekly", "trend_daily", "period_labels",
         "filter_date_range", "ingest_coerce_dates", "acquire_last_n_days", "csv_roundtrip"]


@pytest.fixture
def la_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    yield
    spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("name", NAMES)
def test_non_utc_session(spark, sf_dir, duck, la_zone, name):
    assert rows_of(E.queries()[name](spark, sf_dir)) == rows_of_sql(duck, E.oracle_sql()[name])[0]
