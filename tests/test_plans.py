"""Plan invariants of every registered query (guards against regressions).

- the fact table is scanned at most once per query, by the plan that ran
  (an exchange that two branches read runs once);
- no cartesian product or nested-loop join (no all-pairs work);
- row-level Python appears only in the HTML extraction queries;
- reports are lazy: building one runs no job.
"""

import pytest

from tally.operators.merchant import merchant_analysis
from tally.operators.summary import describe_amounts, summary_statistics
from tally.plans import queries
from tally.sources.fixtures import ledger

QUERIES = queries.build()


def final_plan(df):
    """Text of the plan that ran, without the plan it started from."""
    ex = df._jdf.queryExecution()
    plan = ex.executedPlan().toString()
    return plan.split("\n+- == Initial Plan ==")[0]  # the outermost one


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_invariants(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = final_plan(df)
    if plan.count("lineitem.parquet") > 1:
        df.collect()
        plan = final_plan(df)
        assert "Reused" in plan
    assert scans(plan) <= 1
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDFs
    if "MapInPandas" in plan or "PythonMapInArrow" in plan:
        assert name.startswith("html_extract")


def scans(plan):
    """Scans of the fact table outside of branches that reuse an exchange."""
    lines, count, skip = plan.splitlines(), 0, None
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if skip is not None and depth > skip:
            continue
        skip = depth if "Reused" in line else None
        count += "lineitem.parquet" in line
    return count


def test_reports_run_nothing_before_an_action(spark, sf_dir):
    led = ledger(spark, sf_dir)  # measures its join sides on first use
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "plan construction")
    try:
        summary_statistics(led).header
        describe_amounts(led)
        merchant_analysis(led, top_n=None).frames()
        assert len(tracker.getJobIdsForGroup("lazy")) == 0
    finally:
        spark.sparkContext.setJobGroup("default", "")
