"""Documents in parts: put together they are the document, whatever the lists hold."""

import json
import os

import pytest

from tally.operators import export
from tally.operators.account import account_summary
from tally.operators.category import category_analysis
from tally.operators.custom import custom_report
from tally.operators.document_parts import write_document, write_report_json
from tally.operators.merchant import merchant_analysis
from tally.operators.pnl import profit_and_loss
from tally.operators.trend import trend
from tally.session import scratch_dir
from tally.sources.fixtures import ledger


def _text(path):
    parts = sorted(f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-"))
    return "".join(open(os.path.join(path.removeprefix("file:"), f), encoding="utf-8").read() for f in parts), len(parts)


def test_equal_to_the_single_document(spark, sf_dir):
    led = ledger(spark, sf_dir)
    for report in (profit_and_loss(led), category_analysis(led), merchant_analysis(led, top_n=None), trend(led, grouping="quarterly")):
        text, _ = _text(write_report_json(report, scratch_dir(spark, "t-doc")))
        assert json.loads(text) == json.loads(export.report_json(report).first().document)


def test_accounts_by_many_tasks(spark, sf_dir):
    report = account_summary(ledger(spark, sf_dir))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text, parts = _text(write_report_json(report, scratch_dir(spark, "t-doc")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    doc = json.loads(text)
    assert parts > 1 and doc["report_type"] == "Account Summary"
    want = [{k: v for k, v in r.asDict().items() if v is not None} for r in report.details.collect()]
    assert doc["accounts"] == want and len(want) > 50


def test_awkward_lists(spark, monkeypatch):
    rows = [("a\nb", "1.00"), ('q"},{', "-2.00"), ("]}", "3.00"), (",", "-1.00"), ("", "2.00"), (None, "7.00")]
    df = spark.createDataFrame(rows, "merchant string, amount string") \
        .selectExpr("timestamp_ntz'2024-01-01 00:00:00' date", "merchant", "merchant category", "cast(amount as decimal(18,2)) amount")
    report = merchant_analysis(df, top_n=None)
    doc = json.loads(_text(write_report_json(report, scratch_dir(spark, "t-doc")))[0])
    assert [m["merchant"] for m in doc["merchants"]] == [r.merchant for r in report.details.collect()]
    empty = json.loads(_text(write_report_json(profit_and_loss(df.limit(0)), scratch_dir(spark, "t-doc")))[0])
    assert empty["income_by_category"] == [] == empty["expenses_by_category"]
    monkeypatch.setattr(export, "MAX_DOCUMENT_ROWS", 2)
    long = json.loads(_text(write_document(report, scratch_dir(spark, "t-doc")))[0])
    assert long == doc
    with pytest.raises(ValueError):
        write_report_json(custom_report(df), scratch_dir(spark, "t-doc"))
