"""Reports vs a plain-Python model of the semantics on small random inputs."""

import random
import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest

from tally.operators.account import account_summary
from tally.operators.cash_flow import cash_flow
from tally.operators.category import category_analysis
from tally.operators.compare import period_comparison
from tally.operators.merchant import merchant_analysis
from tally.operators.pnl import profit_and_loss
from tally.operators.trend import trend
from tally.schema import TXN_SCHEMA

CATS = ["Food", "food", "", None, "Rent", "Travel"]
MERCH = ["Shop A", "Shop B", None, "Cafe", "Rail"]
ACCTS = ["Checking", "Savings", None]


def gen(seed, n=150):
    rnd = random.Random(seed)
    rows = []
    base = datetime(2023, 12, 20)
    for _ in range(n):
        d = None if rnd.random() < 0.05 else base + timedelta(days=rnd.randint(0, 120),
                                                               hours=rnd.choice([0, 0, 13]))
        a = rnd.choice([None, D("0.00"), D(rnd.randint(-50000, 50000)) / 100, D("12.50"), D("-12.50")])
        rows.append((d, "x", a, rnd.choice(CATS), rnd.choice(ACCTS), rnd.choice(MERCH), None))
    return rows


def fl(x):
    return float(x)


def label(d, g):
    if g == "monthly":
        return d.strftime("%Y-%m")
    mon = (d - timedelta(days=d.weekday())).date()
    return f"{mon:%Y-%m-%d}/{mon + timedelta(days=6):%Y-%m-%d}"


SEEDS = [1, 2, 3]


@pytest.fixture(scope="module", params=SEEDS)
def case(request, spark):
    rows = gen(request.param)
    return rows, spark.createDataFrame(rows, TXN_SCHEMA)


def test_pnl(case):
    rows, df = case
    inc = [r for r in rows if r[2] is not None and r[2] > 0]
    exp = [r for r in rows if r[2] is not None and r[2] < 0]
    ti, te = sum((r[2] for r in inc), D(0)), abs(sum((r[2] for r in exp), D(0)))
    rep = profit_and_loss(df)
    h = rep.header.first()
    assert (h.total_income, h.total_expenses, h.net_income) == (fl(ti), fl(te), fl(ti - te))
    assert (h.transaction_count, h.income_transaction_count, h.expense_transaction_count) == \
        (len(rows), len(inc), len(exp))
    by = defaultdict(list)
    for r in exp:
        if r[3] is not None:
            by[r[3]].append(r[2])
    want = sorted(((c, fl(abs(sum(v))), len(v), abs(fl(sum(v)) / len(v)),
                    abs(fl(sum(v))) / fl(te) * 100.0) for c, v in by.items()),
                  key=lambda x: (-x[1], x[0]))
    got = [tuple(r) for r in rep.sections["expenses_by_category"].collect()]
    assert got == want


@pytest.mark.parametrize("g", ["monthly", "weekly"])
def test_cash_flow(case, g):
    rows, df = case
    per = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            per[label(r[0], g)].append(r[2])
    want, bal = [], D(0)
    for p in sorted(per):
        a = [x for x in per[p] if x is not None]
        i, o = sum((x for x in a if x > 0), D(0)), abs(sum((x for x in a if x < 0), D(0)))
        bal += i - o
        want.append((p, fl(i), fl(o), fl(i - o), fl(bal), len(per[p])))
    assert [tuple(r) for r in cash_flow(df, grouping=g).details.collect()] == want


def test_category(case):
    rows, df = case
    grand = sum((r[2] for r in rows if r[2] is not None), D(0))
    by = defaultdict(list)
    for r in rows:
        if r[3] is not None:
            by[r[3]].append(r[2])
    got = {r.category: r for r in category_analysis(df).details.collect()}
    assert set(got) == set(by)
    for c, vals in by.items():
        v = [x for x in vals if x is not None]
        g = got[c]
        s = sum(v, D(0))
        assert (g.total, g["count"]) == (fl(s), len(v))
        assert g.average == (fl(s) / len(v) if v else None)
        assert (g.min, g.max) == ((fl(min(v)), fl(max(v))) if v else (None, None))
        assert g.std_dev == pytest.approx(statistics.stdev([fl(x) for x in v]) if len(v) > 1 else 0.0,
                                          rel=1e-9, abs=1e-9)
        assert g.percentage_of_total == (abs(fl(s)) / abs(fl(grand)) * 100.0 if grand != 0 else 0.0)


def test_merchant_top3(case):
    rows, df = case
    grand = sum((r[2] for r in rows if r[2] is not None), D(0))
    by = defaultdict(list)
    for r in rows:
        if r[5] is not None:
            by[r[5]].append(r)
    items = []
    for m, rs in by.items():
        v = [r[2] for r in rs if r[2] is not None]
        cats = Counter(r[3] for r in rs if r[3] is not None)
        top = min(cats.items(), key=lambda kv: (-kv[1], kv[0]))[0] if cats else ""
        s = sum(v, D(0))
        items.append((m, fl(s), len(v), fl(s) / len(v) if v else None, top,
                      abs(fl(s)) / abs(fl(grand)) * 100.0 if grand != 0 else 0.0))
    want = sorted(items, key=lambda x: (-abs(x[1]), x[0]))[:3]
    assert [tuple(r) for r in merchant_analysis(df, top_n=3).details.collect()] == want


def test_trend_top_category(case):
    rows, df = case
    per = defaultdict(lambda: defaultdict(D))
    seen = set()
    for r in rows:
        if r[0] is None:
            continue
        p = label(r[0], "monthly")
        seen.add(p)
        if r[2] is not None and r[2] < 0 and r[3] is not None:
            per[p][r[3]] += r[2]
    want = {p: (min(per[p].items(), key=lambda kv: (kv[1], kv[0]))[0] if per[p] else None) for p in seen}
    got = {r.period: r.top_expense_category for r in trend(df).details.collect()}
    assert got == want


def test_accounts_and_periods(case):
    rows, df = case
    by = defaultdict(list)
    for r in rows:
        if r[4] is not None:
            by[r[4]].append(r[2])
    want = []
    for a, vals in by.items():
        v = [x for x in vals if x is not None]
        i, e = sum((x for x in v if x > 0), D(0)), abs(sum((x for x in v if x < 0), D(0)))
        want.append((a, fl(i), fl(e), fl(i - e), len(vals)))
    want.sort(key=lambda x: (-abs(x[3]), x[0]))
    assert [tuple(r) for r in account_summary(df).details.collect()] == want
    periods = [("Jan", "2024-01-01", "2024-01-31"), ("Dec-Feb", "2023-12-01", "2024-02-29")]
    got = {r.period: (r.income, r.expenses) for r in period_comparison(df, periods).collect()}
    for name, s, e in periods:
        lo, hi = datetime.fromisoformat(s), datetime.fromisoformat(e)
        v = [r[2] for r in rows if r[0] is not None and lo <= r[0] <= hi and r[2] is not None]
        assert got[name] == (fl(sum((x for x in v if x > 0), D(0))), fl(abs(sum((x for x in v if x < 0), D(0)))))
