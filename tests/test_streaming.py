"""Streaming cash flow equals the batch report, over several micro-batches."""

from pyspark.sql import functions as F

from helpers import rows_of
from tally.operators.cash_flow import cash_flow
from tally.schema import TXN_SCHEMA
from tally.session import scratch_dir
from tally.sources.fixtures import ledger
from tally.streaming.cash_flow_stream import dropped_rows, read_cash_flow, start_cash_flow_stream


def test_stream_equals_batch(spark, sf_dir):
    led = ledger(spark, sf_dir).select(*TXN_SCHEMA.fieldNames())
    base = scratch_dir(spark, "t-stream")
    led.write.option("maxRecordsPerFile", 1000).parquet(f"{base}/src")
    q = start_cash_flow_stream(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", TXN_SCHEMA,
                               watermark="3650 days", max_files_per_trigger=1)
    assert q.awaitTermination(600)
    sink = spark.read.parquet(f"{base}/sink")
    assert sink.select("batch_id").distinct().count() > 1
    for g in ("daily", "monthly"):
        assert rows_of(read_cash_flow(spark, f"{base}/sink", g)) == rows_of(cash_flow(led, grouping=g).details)
    # a replayed batch re-appends identical rows with the same batch id: result unchanged
    sink.where(F.col("batch_id") == 0).write.mode("append").parquet(f"{base}/sink")
    assert rows_of(read_cash_flow(spark, f"{base}/sink", "daily")) == \
        rows_of(cash_flow(led, grouping="daily").details)


def test_a_backlog_takes_a_bounded_number_of_batches(spark, sf_dir):
    led = ledger(spark, sf_dir).select(*TXN_SCHEMA.fieldNames())
    base = scratch_dir(spark, "t-backlog")
    led.repartition(30).write.parquet(f"{base}/src")
    q = start_cash_flow_stream(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", TXN_SCHEMA,
                               watermark="3650 days", max_files_per_trigger=2, max_batches=3)
    assert q.awaitTermination(600)
    assert 1 < spark.read.parquet(f"{base}/sink").select("batch_id").distinct().count() <= 3
    assert rows_of(read_cash_flow(spark, f"{base}/sink", "daily")) == rows_of(cash_flow(led, grouping="daily").details)


def test_late_rows_beyond_watermark_are_dropped(spark):
    from datetime import datetime
    from decimal import Decimal as D
    base = scratch_dir(spark, "t-late")
    mk = lambda rows: spark.createDataFrame(
        [(datetime.fromisoformat(d), "x", D(a), "c", "acc", "m", None) for d, a in rows], TXN_SCHEMA)
    mk([("2024-03-01", "10.00")]).write.parquet(f"{base}/src/f1")
    mk([("2024-03-20", "5.00")]).write.parquet(f"{base}/src/f2")        # moves the watermark
    q = start_cash_flow_stream(spark, f"{base}/src/f*", f"{base}/sink", f"{base}/ck", TXN_SCHEMA,
                               watermark="2 days", max_files_per_trigger=1)
    assert q.awaitTermination(300)
    mk([("2024-03-02", "7.00"), ("2024-03-19", "3.00")]).write.parquet(f"{base}/src/f3")  # late / in time
    q = start_cash_flow_stream(spark, f"{base}/src/f*", f"{base}/sink", f"{base}/ck", TXN_SCHEMA,
                               watermark="2 days", max_files_per_trigger=1)
    assert q.awaitTermination(300)
    assert dropped_rows(q) == 1
    got = {r.period: (r.inflow, r.transaction_count) for r in read_cash_flow(spark, f"{base}/sink").collect()}
    assert got == {"2024-03-01": (10.0, 1), "2024-03-19": (3.0, 1), "2024-03-20": (5.0, 1)}
