"""Cross-report invariants on the whole sf0.001 ledger."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tally.functions.periods import GROUPINGS
from tally.operators.account import account_summary
from tally.operators.cash_flow import cash_flow
from tally.operators.category import category_analysis
from tally.operators.filters import ReportFilter
from tally.operators.pnl import profit_and_loss
from tally.operators.trend import trend
from tally.sources.fixtures import ledger, transactions


@pytest.fixture(scope="module")
def led(spark, sf_dir):
    return ledger(spark, sf_dir).cache()


def test_fixture_keeps_every_lineitem(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert transactions(spark, sf_dir).count() == n
    assert ledger(spark, sf_dir).count() == n


def test_income_minus_expenses_is_net(led):
    h = profit_and_loss(led).header.first()
    total = led.agg(F.sum("amount")).first()[0] or Decimal(0)
    assert h.net_income == float(total)
    assert h.total_income - h.total_expenses == pytest.approx(h.net_income, abs=1e-6)


def test_running_balance_ends_at_net_cash_flow(led):
    for g in GROUPINGS:
        rep = cash_flow(led, grouping=g)
        rows = rep.details.collect()
        h = rep.header.first()
        assert rows[-1].running_balance == h.net_cash_flow
        assert [r.period for r in rows] == sorted(r.period for r in rows)


def test_groupings_agree(led):
    tot = {g: cash_flow(led, grouping=g).header.first() for g in GROUPINGS}
    assert len({(t.total_inflow, t.total_outflow) for t in tot.values()}) == 1
    counts = {g: sum(r.transaction_count for r in trend(led, grouping=g).details.collect())
              for g in GROUPINGS}
    assert len(set(counts.values())) == 1
    assert counts["monthly"] == led.where(F.col("date").isNotNull()).count()


def test_category_sums_cover_total(led):
    rep = category_analysis(led)
    cats = sum(Decimal(str(r.total)) for r in rep.details.collect())
    nulls = led.where(F.col("category").isNull()).agg(F.sum("amount")).first()[0] or Decimal(0)
    assert float(cats + nulls) == rep.header.first().total_amount


def test_include_and_exclude_partition_rows(led):
    inc = ReportFilter(categories=["promo", "SMALL"]).apply(led).count()
    exc = ReportFilter(exclude_categories=["promo", "SMALL"]).apply(led).count()
    assert inc + exc == led.count()
    mi = ReportFilter(merchants=["[13579]$"]).apply(led).count()
    me = ReportFilter(exclude_merchants=["[13579]$"]).apply(led).count()
    assert mi + me == led.count()


def test_account_total_is_sum_of_changes(led):
    rep = account_summary(led)
    s = sum(Decimal(str(r.balance_change)) for r in rep.details.collect())
    assert float(s) == rep.header.first().total_balance_change
