"""CSV / JSON round trips, report document and text rendering."""

import json

from pyspark.sql import functions as F

from helpers import rows_of
from tally.operators.cash_flow import cash_flow
from tally.operators.export import (cash_flow_document, export_csv, export_json, read_exported_csv,
                                    text_schema)
from tally.operators.pnl import profit_and_loss
from tally.operators.render import pnl_text
from tally.session import scratch_dir
from tally.sources.fixtures import ledger
from tally.sources.ingest import normalize, read_transactions


def test_csv_and_json_round_trip(spark, sf_dir):
    led = ledger(spark, sf_dir)
    want = rows_of(led)
    p = export_csv(led, scratch_dir(spark, "t-csv"))
    back = normalize(read_exported_csv(spark, p).withColumns(
        {"l_orderkey": F.col("l_orderkey").cast("bigint"), "l_linenumber": F.col("l_linenumber").cast("int")}),
        date_formats=("yyyy-MM-dd HH:mm:ss",))
    assert rows_of(back.select(*led.columns)) == want
    p = export_json(led, scratch_dir(spark, "t-json"))
    back = normalize(spark.read.schema(text_schema(["l_orderkey", "l_linenumber"])).json(p).withColumns(
        {"l_orderkey": F.col("l_orderkey").cast("bigint"), "l_linenumber": F.col("l_linenumber").cast("int")}),
        date_formats=("yyyy-MM-dd HH:mm:ss",))
    assert rows_of(back.select(*led.columns)) == want


def test_read_transactions_csv(spark, sf_dir):
    led = ledger(spark, sf_dir).drop("l_orderkey", "l_linenumber")
    p = export_csv(led, scratch_dir(spark, "t-csv2"))
    back = read_transactions(spark, p, "csv", date_formats=("yyyy-MM-dd HH:mm:ss",))
    assert rows_of(back) == rows_of(led)


def test_cash_flow_document_matches_frames(spark, sf_dir):
    led = ledger(spark, sf_dir)
    doc = json.loads(cash_flow_document(led, grouping="yearly").first().document)
    rep = cash_flow(led, grouping="yearly")
    assert [p["period"] for p in doc["periods"]] == [r.period for r in rep.details.collect()]
    h = rep.header.first()
    assert doc["total_inflow"] == h.total_inflow and doc["net_cash_flow"] == h.net_cash_flow


def test_pnl_text_layout(spark, sf_dir):
    lines = pnl_text(profit_and_loss(ledger(spark, sf_dir)))
    assert lines[2] == "PROFIT & LOSS REPORT" and lines[3] == "Period: All time"
    assert any(x.startswith("NET INCOME:") or x.startswith("NET LOSS:") for x in lines)
    cat = [x for x in lines if x.startswith("    ") and "%)" in x]
    assert cat and all(len(x.split(" (")[0]) >= 4 + 30 + 1 + 15 for x in cat)


def test_report_json_documents(spark, sf_dir):
    from tally.operators.category import category_analysis
    from tally.operators.export import report_json
    from tally.operators.merchant import merchant_analysis
    from tally.operators.trend import trend
    led = ledger(spark, sf_dir)
    pnl = profit_and_loss(led)
    doc = json.loads(report_json(pnl).first().document)
    h = pnl.header.first()
    assert doc["report_type"] == "Profit & Loss" and doc["total_income"] == h.total_income
    assert [c["category"] for c in doc["expenses_by_category"]] == \
        [r.category for r in pnl.sections["expenses_by_category"].collect()]
    for rep, key in ((category_analysis(led), "categories"), (merchant_analysis(led), "merchants"),
                     (trend(led, grouping="quarterly"), "periods")):
        d = json.loads(report_json(rep).first().document)
        assert [list(x.values()) for x in d[key]] == [list(r.asDict().values()) for r in rep.details.collect()]


def test_text_layouts(spark, sf_dir):
    from tally.operators.account import account_summary
    from tally.operators.category import category_analysis
    from tally.operators.merchant import merchant_analysis
    from tally.operators.render import report_text, write_text
    from tally.operators.trend import trend
    led = ledger(spark, sf_dir)
    cf = report_text(cash_flow(led, grouping="yearly"))
    assert cf[2] == "CASH FLOW REPORT (YEARLY)" and cf[-3].startswith("TOTAL")
    assert len([x for x in cf if x[:4].isdigit()]) == cash_flow(led, grouping="yearly").details.count()
    cat = report_text(category_analysis(led, top_n=3))
    assert "Top 3 Categories" in cat and cat[-3].endswith("(3 categories)")
    assert report_text(merchant_analysis(led))[2] == "MERCHANT/PAYEE ANALYSIS REPORT (Top 20)"
    assert report_text(trend(led))[2] == "TREND ANALYSIS REPORT (MONTHLY)"
    accounts = account_summary(led)
    acc = report_text(accounts)
    assert acc[2] == "ACCOUNT SUMMARY REPORT" and len(acc) == 7 + accounts.details.count() + 4
    assert report_text(merchant_analysis(led, top_n=5))[2] == "MERCHANT/PAYEE ANALYSIS REPORT (Top 5)"
    folder = write_text(accounts, scratch_dir(spark, "t-text"))
    assert [r.value for r in spark.read.text(folder).collect()] == acc[7:-4]
