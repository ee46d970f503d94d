"""Inputs and requests at the edges: files, windows, large sums, stored tables."""

import json
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from helpers import rows_of, rows_of_sql
from tally.__main__ import main
from tally.operators.compare import period_comparison
from tally.operators.custom import custom_report
from tally.operators.export import export_csv, export_json, read_exported_csv, report_json
from tally.operators.filters import ReportFilter, TxnFilter
from tally.operators.merchant import merchant_analysis
from tally.operators.stats import moment_aggs, stddev_samp
from tally.operators.summary import describe_amounts
from tally.plans import oracle
from tally.plans.queries import _array_documents, _array_ledger
from tally.plans.spec import Reports, ReportSpec
from tally.schema import TXN_SCHEMA
from tally.session import scratch_dir
from tally.sources.acquire import acquire
from tally.sources.fixtures import ledger
from tally.sources.ingest import read_transactions
from tally.sources.store import read_store, write_store

TEXTS = [None, "", "\\N", " lead ", 'He said "hi", ok', "line\nbreak", "cr\r\nlf", "back\\slash\\", '"q"', "null", ",", "\\", "#x", "ünï"]


def table(spark, texts):
    rows = [(datetime(2025, 1, 1 + i % 28, i % 24), t, D(i) / 4, "c", f"a{i}", "m", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, TXN_SCHEMA)


def put(folder, name, text):
    folder = folder.removeprefix("file:")
    import os
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as f:
        f.write(text)
    return folder


@pytest.mark.parametrize("fmt, write", [("csv", export_csv), ("json", export_json)])
def test_difficult_text_survives(spark, fmt, write):
    df = table(spark, TEXTS)
    back = read_transactions(spark, write(df, scratch_dir(spark, "edge")), fmt)
    assert rows_of(back.select(*df.columns)) == rows_of(df)


def test_csv_files_must_agree_on_their_header(spark):
    folder = put(scratch_dir(spark, "edge"), "a.csv", "date,amount\n2025-01-01,1\n")
    put(folder, "b.csv", "amount,date\n2,2025-01-02\n")
    with pytest.raises(Exception):
        read_exported_csv(spark, folder).collect()


def test_json_lines_beside_array_documents(spark, tmp_path):
    """Each file is read as what it is, also where the kinds have other fields."""
    folder = tmp_path / "mixed files"
    folder.mkdir()
    array = [{"date": "2025-01-02", "amount": str(i), "account": "a", "extra": {"x": str(i)}} for i in range(7)]
    lines = [{"date": "2025-01-03", "amount": str(10 + i), "notes": "n", "extra": "text"} for i in range(3)]
    (folder / "b 1.json").write_text("\n\t " + json.dumps(array, indent=1))
    (folder / "c.json").write_text(json.dumps(array[:2]))
    (folder / "d.json").write_text(" \n")
    for name in ("a%20.json", "z.json"):
        (folder / name).write_text("".join(json.dumps(r) + "\n" for r in lines))
    found = read_transactions(spark, str(folder), "json").collect()
    assert sorted(int(r["amount"]) for r in found) == sorted([*range(7), 0, 1, *[10, 11, 12] * 2])
    assert {(r["account"], r["notes"]) for r in found} == {("a", None), (None, "n")}
    assert sorted(json.loads(r["extra"])["x"] for r in found if r["extra"] != "text") == sorted([*"0123456", "0", "1"])


def test_json_mixed_partition_folders(spark, tmp_path):
    for name, text in (("year=2024", '[{"amount": "1"}, {"amount": "2"}]'), ("year=2025", '{"amount": "3"}\n{"amount": "4"}\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(text)
    found = read_transactions(spark, str(tmp_path), "json").collect()
    assert sorted((int(r["amount"]), r["year"]) for r in found) == [(1, 2024), (2, 2024), (3, 2025), (4, 2025)]


def test_whole_ledger_in_array_documents(spark, duck, sf_dir):
    """Against the SQL of ingest_normalize, which has the same rows; documents are bounded, a file each."""
    assert rows_of(_array_ledger(spark, sf_dir)) == rows_of_sql(duck, oracle.build()["ingest_normalize"])[0]
    sizes = [len(json.loads(r["value"])) for r in _array_documents(ledger(spark, sf_dir)).collect()]
    assert sum(sizes) == ledger(spark, sf_dir).count() and len(sizes) > 2 and max(sizes) <= 2048


def test_json_array_and_absent_fields(spark):
    docs = [{"date": "2025-01-01T10:00:00Z", "amount": 1.5, "category": "x"}, {"date": "2025-01-02", "amount": -2, "extra": "kept"}]
    folder = put(scratch_dir(spark, "edge"), "a.json", json.dumps(docs, indent=2))
    df = read_transactions(spark, folder, "json")
    assert sorted((r["date"], r["amount"]) for r in df.collect()) == [(datetime(2025, 1, 1, 10), D("1.50")), (datetime(2025, 1, 2), D("-2.00"))]
    assert "extra" in df.columns
    assert ReportFilter(notes_contains="x").apply(df).count() == 2  # the files have no notes


def test_bad_json_fails(spark):
    folder = put(scratch_dir(spark, "edge"), "a.json", '{"date": "2025-01-01", "amount": 1}\n{"date": oops\n')
    with pytest.raises(ValueError, match="malformed"):
        read_transactions(spark, folder, "json")


@pytest.mark.parametrize("text, want", [
    ("2025-01-01T10:00:00", datetime(2025, 1, 1, 10)), ("2025-01-01 10:00:00.25", datetime(2025, 1, 1, 10, 0, 0, 250000)),
    ("2025-01-01T10:00:00Z", datetime(2025, 1, 1, 10)), ("2025-01-01T10:00:00.5+02:00", datetime(2025, 1, 1, 8, 0, 0, 500000)),
    ("01/15/2025", None), ("2025", None), ("2025-13-01", None)])
def test_iso_dates(spark, text, want):
    folder = put(scratch_dir(spark, "edge"), "a.csv", f"date,amount\n{text},1\n")
    assert read_transactions(spark, folder, "csv").first()["date"] == want


def test_last_days_keeps_the_whole_last_day(spark):
    df = table(spark, ["x"] * 48).withColumn("date", F.lit(datetime(2025, 1, 10, 15)).cast("timestamp_ntz"))
    spec = ReportSpec("profit_loss", last_days=10, as_of="2025-01-10")
    assert spec.run(df).header.first().transaction_count == acquire(df, days=10, as_of="2025-01-10").count() == 48
    assert acquire(df, days=5000, as_of="2025-01-10").count() == 48


def test_summary_of_listed_rows(spark):
    df = table(spark, TEXTS)
    got = Reports(df).summary(ReportFilter(min_amount=1), rows=TxnFilter(description="i")).header.first()
    want = [r for r in df.collect() if r["amount"] >= 1 and "i" in (r["description"] or "").lower()]
    assert got.total_transactions == len(want) and got.total_amount == float(sum(r["amount"] for r in want))


def test_deviation_of_very_many_large_values(spark):
    """The sums of 2e11 rows near 9e8, built from those of 2,000."""
    x = spark.range(2000).select((F.lit(900_000_000) + F.col("id") % 7).cast("decimal(18,2)").alias("x"))
    times = F.lit(10**8).cast("decimal(9,0)")
    big = x.agg(*moment_aggs(F.col("x"))).select((F.col("s") * times).cast("decimal(38,2)").alias("s"),
                                                 (F.col("n") * 10**8).alias("n"), (F.col("sq") * times).cast("decimal(38,4)").alias("sq"))
    assert big.select(stddev_samp(F.col("s"), F.col("n"), F.col("sq"))).first()[0] == pytest.approx(1.99937, abs=1e-4)


def test_quantiles_in_units_of_the_scale(spark):
    df = spark.createDataFrame([("0.0010",), ("0.0020",), ("0.0030",)], "a string").select(F.col("a").cast("decimal(18,4)").alias("amount"))
    got = describe_amounts(df).first()
    assert (got["p50"], got["min"], got["max"]) == (0.002, 0.001, 0.003) and got["std"] == pytest.approx(0.001)


def test_many_periods_match_few(spark, sf_dir):
    led = ledger(spark, sf_dir).withColumn("date", F.col("date") + F.make_dt_interval(hours=(F.col("l_orderkey") % 3).cast("int")))
    periods = [(f"{y}-{m}", f"{y}-{m:02d}-01", f"{y}-{m:02d}-28") for y in range(1992, 1999) for m in range(1, 13)] + [("none", "1995-02-01", "1995-01-01")]
    many = rows_of(period_comparison(led, periods))
    few = sorted(r for i in range(0, len(periods), 30) for r in rows_of(period_comparison(led, periods[i:i + 30])))
    assert len(many) == len(periods) and many == few


def test_group_by_absent_column_gives_the_rows(spark):
    folder = put(scratch_dir(spark, "edge"), "a.csv", "date,amount\n2025-01-01,1\n2025-01-02,2\n")
    df = read_transactions(spark, folder, "csv")
    assert custom_report(df, group_by="merchant").details.count() == 2


def test_store_prunes_and_pushes(spark, sf_dir):
    led = ledger(spark, sf_dir)
    st = read_store(spark, write_store(led, scratch_dir(spark, "edge")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    compared = plan(period_comparison(st, [("a", "1996-01-01", "1996-03-31"), ("b", "1996-06-01", "1996-06-30")]))
    assert "txn_month#" in compared.split("PartitionFilters: [")[1].split("]")[0] and "1996-01" in compared
    assert "1996-11" in plan(acquire(st, days=40, as_of="1996-12-31")).split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan(ReportFilter(categories=["Promo"], accounts=["customer#000000007"]).apply(st)).split("PushedFilters: [")[1]
    assert "category_lc" in pushed and "account_lc" in pushed
    shown = custom_report(st).details
    assert sorted(shown.columns) == sorted(led.columns) and rows_of(shown.select(*led.columns)) == rows_of(led)


def test_document_refuses_unbounded_lists(spark, sf_dir, monkeypatch):
    from tally.operators import export
    monkeypatch.setattr(export, "MAX_DOCUMENT_ROWS", 2)
    with pytest.raises(ValueError, match="export_json"):
        report_json(merchant_analysis(ledger(spark, sf_dir), top_n=None))


def test_python_only_classes_work(spark):
    assert ReportFilter(merchants=["[[]"]).apply(table(spark, ["x"])).count() == 0


def test_cli_actions(spark, sf_dir):
    src = export_json(ledger(spark, sf_dir).drop("l_orderkey", "l_linenumber"), scratch_dir(spark, "edge"))
    for action, frame in (("accounts", "accounts"), ("categories", "categories"), ("summary", "header"), ("transactions", "transactions")):
        out = scratch_dir(spark, "edge")
        assert main([action, "--input", src, "--format", "json", "--start-date", "1996-01-01", "--end-date", "1996-12-31",
                     "--limit", "7", "--out", out, "--csv"]) == 0
        rows = read_exported_csv(spark, f"{out}/{frame}").collect()
        assert rows and (action != "transactions" or len(rows) == 7)
    out = scratch_dir(spark, "edge")
    assert main(["report", "--input", src, "--format", "json", "--report", "cash_flow", "--document", "--out", out]) == 0
    doc = json.loads(spark.read.text(f"{out}/reports/*").first().value)
    assert doc["report_type"] == "Cash Flow" and doc["periods"]


def test_one_scan_for_all_frames_of_a_profit_and_loss_job(spark, sf_dir):
    src = scratch_dir(spark, "edge")
    ledger(spark, sf_dir).drop("l_orderkey", "l_linenumber").write.parquet(src)
    rep = ReportSpec("profit_loss").run(spark.read.parquet(src), materialize=True)
    assert all("FileScan" not in f._jdf.queryExecution().executedPlan().toString() for f in rep.frames().values())
