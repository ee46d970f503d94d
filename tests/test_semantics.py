"""Hand-written frames for each rule of the semantics ledger."""

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tally.functions.money import format_currency, format_percent
from tally.functions.periods import period_label
from tally.operators.category import category_analysis
from tally.operators.compare import period_comparison
from tally.operators.custom import ReportSort, custom_report
from tally.operators.filters import ReportFilter, TxnFilter
from tally.operators.merchant import merchant_analysis
from tally.operators.pnl import profit_and_loss
from tally.operators.trend import trend
from tally.plans.spec import ReportSpec
from tally.schema import TXN_SCHEMA
from tally.sources.acquire import acquisition_window
from tally.sources.ingest import normalize, parse_currency_text


def txns(spark, rows):
    """rows: (date, amount, category, merchant[, account, description, notes])"""
    full = []
    for r in rows:
        d, a, c, m = r[:4]
        acct = r[4] if len(r) > 4 else "A1"
        desc = r[5] if len(r) > 5 else "desc"
        notes = r[6] if len(r) > 6 else None
        full.append((d, desc, None if a is None else D(str(a)), c, acct, m, notes))
    return spark.createDataFrame(full, TXN_SCHEMA)


def dt(s):
    return datetime.strptime(s, "%Y-%m-%d %H:%M") if " " in s else datetime.strptime(s, "%Y-%m-%d")


def test_mode_tie_takes_smallest_and_ignores_nulls(spark):
    df = txns(spark, [(dt("2024-01-01"), -1, c, "M") for c in ["b", "a", "b", "a", None, None, None]]
              + [(dt("2024-01-01"), -1, None, "N")])
    out = {r.merchant: r.primary_category for r in merchant_analysis(df, top_n=None).details.collect()}
    assert out == {"M": "a", "N": ""}


def test_argmin_category_tie_takes_smallest(spark):
    df = txns(spark, [(dt("2024-01-05"), -10, "b", "x"), (dt("2024-01-06"), -10, "a", "x"),
                      (dt("2024-01-07"), 50, "c", "x"), (dt("2024-02-01"), 20, "a", "x"),
                      (dt("2024-03-01"), -5, None, "x")])
    rows = {r.period: r for r in trend(df).details.collect()}
    assert rows["2024-01"].top_expense_category == "a"
    assert rows["2024-02"].top_expense_category is None  # no expenses
    assert rows["2024-03"].top_expense_category is None  # expenses without a category
    assert rows["2024-01"].income == 50.0 and rows["2024-01"].expenses == 20.0


def test_single_row_std_zero_and_all_null_group(spark):
    df = txns(spark, [(dt("2024-01-01"), 12.5, "one", "m"), (dt("2024-01-01"), None, "none", "m"),
                      (dt("2024-01-01"), None, "none", "m")])
    rows = {r.category: r for r in category_analysis(df).details.collect()}
    assert rows["one"].std_dev == 0.0 and rows["one"]["count"] == 1
    n = rows["none"]
    assert (n.total, n["count"], n.average, n.min, n.max, n.std_dev) == (0.0, 0, None, None, None, 0.0)


def test_zero_grand_total_gives_zero_shares(spark):
    df = txns(spark, [(dt("2024-01-01"), 5, "a", "m1"), (dt("2024-01-01"), -5, "b", "m2")])
    assert {r.percentage_of_total for r in category_analysis(df).details.collect()} == {0.0}
    assert {r.percentage_of_total for r in merchant_analysis(df).details.collect()} == {0.0}


def test_std_matches_sample_formula(spark):
    vals = [1.25, 2.5, -3.75, 10.0]
    df = txns(spark, [(dt("2024-01-01"), v, "c", "m") for v in vals])
    import statistics
    r = category_analysis(df).details.first()
    assert r.std_dev == pytest.approx(statistics.stdev(vals), rel=1e-15)


def test_week_label_across_year_end(spark):
    df = spark.createDataFrame([(dt(s),) for s in ["2024-12-30", "2025-01-05", "2025-01-06"]],
                               "date timestamp_ntz")
    got = [r.w for r in df.select(period_label(F.col("date"), "weekly").alias("w")).collect()]
    assert got == ["2024-12-30/2025-01-05", "2024-12-30/2025-01-05", "2025-01-06/2025-01-12"]
    q = [r.q for r in df.select(period_label(F.col("date"), "quarterly").alias("q")).collect()]
    assert q == ["2024Q4", "2025Q1", "2025Q1"]


def test_end_date_is_midnight_inclusive(spark):
    df = txns(spark, [(dt("2024-03-31 10:00"), 1, "a", "m"), (dt("2024-03-31"), 2, "a", "m")])
    assert ReportFilter(end_date="2024-03-31").apply(df).count() == 1
    assert ReportFilter(end_date="2024-03-31", end_inclusive_day=True).apply(df).count() == 2


def test_currency_and_percent_formatting(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (-5.0,), (1234567.5,)], "x double")
    got = [r.t for r in df.select(format_currency(F.col("x")).alias("t")).collect()]
    assert got == ["$0.12", "$2.67", "$-5.00", "$1,234,567.50"]
    pct = [r.p for r in df.select(format_percent(F.col("x")).alias("p")).collect()]
    assert pct == ["0.1%", "2.7%", "-5.0%", "1234567.5%"]


def test_include_drops_null_exclude_keeps_null(spark):
    df = txns(spark, [(dt("2024-01-01"), 1, "Food", "Shop A"), (dt("2024-01-01"), 1, None, None),
                      (dt("2024-01-01"), 1, "rent", "Landlord")])
    assert ReportFilter(categories=["FOOD"]).apply(df).count() == 1
    assert ReportFilter(exclude_categories=["food"]).apply(df).count() == 2
    assert ReportFilter(merchants=["shop", "LORD$"]).apply(df).count() == 2
    assert ReportFilter(exclude_merchants=["shop"]).apply(df).count() == 2


def test_bad_regex_fails_before_planning():
    with pytest.raises(ValueError):
        ReportFilter(merchants=["("])


def test_amount_and_date_coercion(spark):
    raw = spark.createDataFrame(
        [("2024-01-05", "1,000"), ("junk", "$3"), ("2023-02-30", " 7 "), ("2025", "1e3"),
         ("2024-02-29", "1.005"), (None, "nan")], "date string, amount string")
    rows = normalize(raw).select("date", "amount").collect()
    assert [r.amount for r in rows] == [None, None, D("7.00"), D("1000.00"), D("1.01"), None]
    assert [r.date for r in rows] == [dt("2024-01-05"), None, None, None, dt("2024-02-29"), None]
    assert normalize(raw).columns[:7] == ["date", "description", "amount", "category", "account",
                                          "merchant", "notes"]


def test_nan_amount_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,)], "amount double")
    assert [r.amount for r in normalize(df).select("amount").collect()] == [None, D("1.50")]


def test_currency_text_failure_is_zero(spark):
    df = spark.createDataFrame([("$1,234.50",), ("abc",), (None,), ("-$5",)], "t string")
    got = [r.a for r in df.select(parse_currency_text(F.col("t")).alias("a")).collect()]
    assert got == [D("1234.50"), D("0.00"), D("0.00"), D("-5.00")]


def test_empty_pnl_emits_all_keys_as_zero(spark):
    df = txns(spark, [(dt("2024-01-01"), 5, "a", "m")])
    h = profit_and_loss(df, ReportFilter(start_date="2030-01-01")).header.first().asDict()
    assert h == {"period": "From 2030-01-01", "total_income": 0.0, "total_expenses": 0.0,
                 "net_income": 0.0, "transaction_count": 0, "income_transaction_count": 0,
                 "expense_transaction_count": 0}


def test_pnl_shares_and_null_category_in_totals(spark):
    df = txns(spark, [(dt("2024-01-01"), 30, "a", "m"), (dt("2024-01-01"), 10, None, "m"),
                      (dt("2024-01-01"), -20, "b", "m"), (dt("2024-01-01"), 0, "c", "m"),
                      (dt("2024-01-01"), None, "c", "m")])
    r = profit_and_loss(df)
    h = r.header.first()
    assert (h.total_income, h.total_expenses, h.net_income) == (40.0, 20.0, 20.0)
    assert (h.transaction_count, h.income_transaction_count, h.expense_transaction_count) == (5, 2, 1)
    inc = r.sections["income_by_category"].collect()
    assert [(x.category, x.percentage_of_income) for x in inc] == [("a", 75.0)]


def test_top_n_and_category_count(spark):
    df = txns(spark, [(dt("2024-01-01"), v, c, "m") for v, c in [(5, "a"), (7, "b"), (1, "c"), (7, "d")]])
    r = category_analysis(df, top_n=2)
    assert [x.category for x in r.details.collect()] == ["b", "d"]
    assert r.header.first().category_count == 2
    assert r.header.first().total_amount == 20.0


def test_custom_report_sort_and_group(spark):
    df = txns(spark, [(dt("2024-01-01"), 5, "a", "m"), (dt("2024-01-02"), None, "a", "m"),
                      (dt("2024-01-03"), -7, "b", "n")])
    rows = custom_report(df, sort=ReportSort("amount", "asc")).details.collect()
    assert [r.amount for r in rows] == [D("-7.00"), D("5.00"), None]  # nulls last
    assert custom_report(df, sort=ReportSort("nope")).details.count() == 3
    g = custom_report(df, group_by="merchant")
    assert [(r.merchant, r.total, r["count"]) for r in g.details.collect()] == [("m", 5.0, 1), ("n", -7.0, 1)]
    empty = custom_report(df, ReportFilter(min_amount=100)).header.first()
    assert (empty.total_amount, empty.transaction_count) == (0.0, 0)


def test_period_comparison_overlap_and_empty(spark):
    df = txns(spark, [(dt("2024-01-15"), 10, "a", "m"), (dt("2024-02-15"), -4, "a", "m")])
    out = {r.period: r for r in period_comparison(df, [("Jan", "2024-01-01", "2024-01-31"),
                                                         ("Q1", "2024-01-01", "2024-03-31"),
                                                         ("none", "2030-01-01", "2030-12-31")]).collect()}
    assert (out["Jan"].income, out["Jan"].expenses) == (10.0, 0.0)
    assert (out["Q1"].income, out["Q1"].expenses, out["Q1"].net_income) == (10.0, 4.0, 6.0)
    assert (out["none"].income, out["none"].expenses, out["none"].net_income) == (0.0, 0.0, 0.0)


def test_txn_filter_missing_as_zero_and_literal_substring(spark):
    df = txns(spark, [(dt("2024-01-01"), None, None, "a.c"), (dt("2024-01-01"), 5, "X", "abc")])
    assert TxnFilter(max_amount=0).apply(df).count() == 1
    assert TxnFilter(merchant="A.C").apply(df).count() == 1
    assert TxnFilter(category="").apply(df).count() == 2  # empty means no filter


def test_acquisition_window():
    assert acquisition_window(days=10, as_of="2024-03-05") == ("2024-02-24", "2024-03-05")
    assert acquisition_window(as_of="2024-03-05") == ("2024-01-01", "2024-03-05")
    assert acquisition_window("2023-01-01", "2023-02-01", as_of="2024-03-05") == ("2023-01-01", "2023-02-01")


@pytest.mark.parametrize("kw", [
    dict(report_type="nope"), dict(report_type="cash_flow", grouping="hourly"),
    dict(report_type="cash_flow", start_date="2024/01/01"), dict(report_type="cash_flow", last_days=0),
    dict(report_type="cash_flow", min_amount=5, max_amount=1), dict(report_type="cash_flow", top_n=1001),
    dict(report_type="cash_flow", categories=["x"] * 101), dict(report_type="cash_flow", merchants=["["]),
    dict(report_type="cash_flow", min_amount=2e9),
])
def test_spec_rejects(kw):
    with pytest.raises(ValueError):
        ReportSpec(**kw)


def test_spec_runs_each_report(spark):
    df = txns(spark, [(dt("2024-01-01"), 5, "a", "m"), (dt("2024-01-09"), -3, "b", "n")])
    for t in ("profit_loss", "cash_flow", "category_analysis", "merchant_analysis",
              "trend_analysis", "account_summary", "custom"):
        rep = ReportSpec(report_type=t, grouping="weekly", group_by="category").run(df)
        assert rep.header.count() == 1
    r = ReportSpec(report_type="cash_flow", last_days=5, as_of="2024-01-10").run(df)
    assert [x.period for x in r.details.collect()] == ["2024-01"]


def test_summary_empty_and_all_null(spark):
    from tally.operators.summary import describe_amounts, summary_statistics
    empty = txns(spark, [])
    h = summary_statistics(empty).header.first().asDict()
    assert h == {"total_transactions": 0, "total_amount": 0.0, "average_amount": None,
                 "min_amount": None, "max_amount": None, "median_amount": None}
    nulls = txns(spark, [(dt("2024-01-01"), None, "a", "m")] * 3)
    h = summary_statistics(nulls).header.first().asDict()
    assert (h["total_transactions"], h["total_amount"], h["median_amount"]) == (3, 0.0, None)
    d = describe_amounts(txns(spark, [(dt("2024-01-01"), v, "a", "m") for v in (1, 2, 3, 4)])).first()
    assert (d["count"], d.p25, d.p50, d.p75, d.min, d.max) == (4, 1.75, 2.5, 3.25, 1.0, 4.0)


def test_median_methods_agree(spark):
    from tally.operators.summary import summary_statistics
    df = txns(spark, [(dt("2024-01-01"), v, "a", "m") for v in (5, -3.5, 7.25, 0, 1024, -2048.01)])
    exact = {m: summary_statistics(df, median=m).header.first().median_amount
             for m in ("select", "percentile")}
    assert exact == {"select": 2.5, "percentile": 2.5}


def test_filter_on_missing_source_column_is_skipped(spark):
    raw = spark.createDataFrame([("2024-01-05", "5.00", "Shop"), ("2024-01-06", "-2.00", "Cafe")],
                                "date string, amount string, merchant string")
    df = normalize(raw)
    f = ReportFilter(categories=["food"], notes_contains="x", merchants=["shop"])
    assert f.apply(df).count() == 1          # category/notes skipped, merchant applied
    assert merchant_analysis(df).details.count() == 2
    assert category_analysis(df).details.count() == 0   # no category column: empty list


def test_python_regex_syntax_runs_on_spark(spark):
    df = txns(spark, [(dt("2024-01-01"), 1, "a", "Shop Shop"), (dt("2024-01-01"), 1, "a", "Ünï Mart"),
                      (dt("2024-01-01"), 1, "a", "Shop Cafe")])
    assert ReportFilter(merchants=[r"(?P<w>shop) (?P=w)"]).apply(df).count() == 1
    assert ReportFilter(merchants=[r"mart\Z"]).apply(df).count() == 1
    assert ReportFilter(merchants=["ÜNÏ"]).apply(df).count() == 1


def test_reports_builder_covers_all(spark):
    from tally.plans.spec import Reports
    df = txns(spark, [(dt("2024-01-01"), 5, "a", "m"), (dt("2024-02-09"), -3, "b", "n")])
    r = Reports(df)
    assert r.summary().header.first().total_transactions == 2
    assert r.describe().first()["count"] == 2
    assert r.period_comparison([("Jan", "2024-01-01", "2024-01-31")]).first().income == 5.0
    assert r.merchant_analysis(top_n=None).details.count() == 2


def test_default_date_formats_take_time_of_day(spark):
    raw = spark.createDataFrame([("2024-03-31 10:00:00",), ("2024-03-31",), ("2024-03-31T10:00",)], "date string")
    assert [r.date for r in normalize(raw).select("date").collect()] == \
        [dt("2024-03-31 10:00"), dt("2024-03-31"), None]
