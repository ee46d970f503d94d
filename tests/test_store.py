"""Month-partitioned store: same results, pruned partitions, pushed date filter."""

from helpers import rows_of
from tally.operators.cash_flow import cash_flow
from tally.operators.filters import ReportFilter
from tally.operators.pnl import profit_and_loss
from tally.session import scratch_dir
from tally.sources.fixtures import ledger
from tally.sources.store import read_store, write_store


def test_store_reports_equal_and_prune(spark, sf_dir):
    led = ledger(spark, sf_dir)
    st = read_store(spark, write_store(led, scratch_dir(spark, "t-store")))
    f = ReportFilter(start_date="1996-02-10", end_date="1997-11-03")
    assert rows_of(profit_and_loss(st, f).header) == rows_of(profit_and_loss(led, f).header)
    assert rows_of(cash_flow(st.drop("txn_month"), grouping="weekly").details) == \
        rows_of(cash_flow(led, grouping="weekly").details)
    plan = profit_and_loss(st, f).header._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan and "(txn_month#" in plan
    assert "GreaterThanOrEqual(date,1996-02-10T00:00)" in plan


def test_reports_materialize(spark, sf_dir):
    from tally.plans.spec import Reports, ReportSpec
    led = ledger(spark, sf_dir)
    r = Reports.materialize(led, scratch_dir(spark, "t-mat"))
    spec = ReportSpec(report_type="trend_analysis", grouping="quarterly", start_date="1996-01-01")
    assert rows_of(r.run(spec).details) == rows_of(spec.run(led).details)
