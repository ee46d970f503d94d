"""Many periods from prefix sums: equal to plain sums, no join, one read."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from tally.operators.compare import WIDE_PERIODS, period_comparison


def test_many_overlapping_periods(spark):
    rng = random.Random(3)
    first = datetime(2024, 1, 1)
    rows = [(first + timedelta(days=rng.randint(0, 400), hours=rng.choice([0, 0, 1, 23])), Decimal(rng.randint(-10**9, 10**9)).scaleb(-2))
            for _ in range(3000)] + [(None, Decimal("5.00")), (first, None)] + [(first + timedelta(days=40), Decimal("-1.01"))] * 50
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "date timestamp_ntz, amount decimal(18,2)").repartition(5)

    def text(n):
        return str((first + timedelta(days=n)).date())

    periods = [(f"p{i % 7}", text(a := rng.randint(-30, 430)), text(a + rng.randint(-3, 200))) for i in range(2000)]
    periods += [("day", text(40), text(40)), ("all", "1990-01-01", "2090-01-01"), ("none", "2030-01-01", "2020-01-01")]
    dated = [(d, a) for d, a in rows if d is not None and a is not None]

    def model(start, end):
        inside = [a for d, a in dated if datetime.fromisoformat(start) <= d <= datetime.fromisoformat(end)]
        income, expenses = sum((a for a in inside if a > 0), Decimal(0)), -sum((a for a in inside if a < 0), Decimal(0))
        return float(income), float(expenses), float(income - expenses)

    out = period_comparison(df, periods)
    got = sorted((r.period, r.start_date, r.end_date, r.income, r.expenses, r.net_income) for r in out.collect())
    assert got == sorted((*p, *model(*p[1:])) for p in periods)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(periods) > WIDE_PERIODS


def test_many_periods_over_nothing(spark):
    df = spark.createDataFrame([], "date timestamp_ntz, amount decimal(18,2)")
    out = period_comparison(df, [(str(i), "2024-01-01", "2024-02-01") for i in range(WIDE_PERIODS + 1)]).collect()
    assert len(out) == WIDE_PERIODS + 1 and {(r.income, r.expenses, r.net_income) for r in out} == {(0.0, 0.0, 0.0)}
