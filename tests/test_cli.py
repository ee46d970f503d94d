"""Command-line job: flags → ReportSpec → written frames."""

import os

import pytest

from tally.__main__ import build_parser, main, spec_from_args
from tally.operators.export import export_json
from tally.session import scratch_dir
from tally.sources.fixtures import ledger


def test_flags_map_to_spec():
    a = build_parser().parse_args(["report", "--input", "x", "--report", "category_analysis",
                                   "--categories", "Food,rent", "--top-n", "3", "--max-amount", "-0.01"])
    s = spec_from_args(a)
    assert (s.report_type, s.categories, s.top_n, s.max_amount) == ("category_analysis", ["Food", "rent"], 3, -0.01)
    with pytest.raises(ValueError):
        spec_from_args(build_parser().parse_args(["report", "--input", "x", "--report", "cash_flow",
                                                  "--last-days", "0"]))


def test_report_job_writes_frames(spark, sf_dir):
    src = export_json(ledger(spark, sf_dir).drop("l_orderkey", "l_linenumber"), scratch_dir(spark, "t-cli-in"))
    out = scratch_dir(spark, "t-cli-out")
    assert main(["report", "--input", src, "--format", "json", "--date-format", "yyyy-MM-dd HH:mm:ss",
                 "--report", "profit_loss", "--start-date", "1997-01-01", "--out", out]) == 0
    local = out[len("file:"):] if out.startswith("file:") else out
    assert sorted(os.listdir(local)) == ["by_category", "expenses_by_category", "header", "income_by_category"]
    header = spark.read.json(f"{out}/header").first()
    assert header.period == "From 1997-01-01"
    assert header.transaction_count > 0
