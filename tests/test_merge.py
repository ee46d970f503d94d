"""Repeated, overlapping downloads into the store."""

import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tally.operators.filters import ReportFilter
from tally.schema import TXN_SCHEMA
from tally.session import scratch_dir
from tally.sources.merge import COPIES, merge_store, missing_rows
from tally.sources.store import read_store, write_store
from tally.sources.text_index import write_text_index

FIELDS = TXN_SCHEMA.fieldNames()


def row(day, amount="1.00", text="coffee", category="food"):
    date = None if day is None else datetime(2024, 1, 1) + timedelta(days=day)
    return (date, text, None if amount is None else Decimal(amount), category, "A", "Shop", None)


def frame(spark, rows):
    return spark.createDataFrame(rows, TXN_SCHEMA)


def counted(df):
    return Counter(tuple(r) for r in df.select(*FIELDS).collect())


def files(path):
    folder = Path(path.removeprefix("file:"))
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def started(spark, rows):
    return write_store(frame(spark, rows), scratch_dir(spark, "t-merge"))


def test_overlapping_windows_equal_the_largest_counts(spark):
    rng = random.Random(7)
    truth = [row(rng.choice([None, *range(0, 120)]), rng.choice(["1.00", "2.50", None]), rng.choice(["coffee", "tea", None, ""]))
             for _ in range(600)]
    truth += truth[:80]
    inside = lambda a, b: [r for r in truth if r[0] is None or a <= (r[0] - datetime(2024, 1, 1)).days <= b]
    path = started(spark, inside(0, 50))
    want = Counter(inside(0, 50))
    for a, b in ((30, 80), (30, 80), (70, 119), (0, 119)):
        merge_store(spark, path, frame(spark, inside(a, b)))
        want |= Counter(inside(a, b))
        assert counted(read_store(spark, path)) == want
    assert want == Counter(truth)


def test_second_load_and_other_months_change_no_file(spark):
    path = started(spark, [row(1), row(1), row(40)])
    january = frame(spark, [row(1), row(1), row(1), row(2)])
    before = files(path)
    merge_store(spark, path, january)
    after = files(path)
    assert before.items() <= after.items()
    assert {f.split("/")[0] for f in set(after) - set(before)} == {"txn_month=2024-01"}
    merge_store(spark, path, january)
    assert files(path) == after
    assert counted(read_store(spark, path)) == Counter({row(1): 3, row(2): 1, row(40): 1})


def test_rows_that_a_download_lacks_stay_and_nulls_are_equal(spark):
    path = started(spark, [row(1), row(None), row(None, None, None, None)])
    merge_store(spark, path, frame(spark, [row(None), row(None), row(None, None, None, None)]))
    assert counted(read_store(spark, path)) == Counter({row(1): 1, row(None): 2, row(None, None, None, None): 1})


def test_empty_download_and_empty_store(spark):
    path = started(spark, [row(1)])
    before = files(path)
    merge_store(spark, path, frame(spark, []))
    assert files(path) == before
    store = read_store(spark, path).where("false")
    assert counted(missing_rows(store, frame(spark, [row(1), row(1)]))) == Counter({row(1): 2})


def test_columns(spark):
    path = started(spark, [row(1)])
    some = frame(spark, [row(3)]).drop("notes", "account")
    merge_store(spark, path, some)
    assert sum(counted(read_store(spark, path)).values()) == 2
    assert read_store(spark, path).where("account is null and notes is null and category_lc = 'food'").count() == 1
    with pytest.raises(ValueError, match="no column extra"):
        merge_store(spark, path, frame(spark, [row(1)]).selectExpr("*", "1 AS extra"))


def test_very_many_copies_of_one_row(spark):
    path = started(spark, [row(1)] * 3)
    copies = 5 * COPIES + 17
    merge_store(spark, path, frame(spark, [row(1)]).crossJoin(spark.range(copies)).drop("id"))
    assert read_store(spark, path).count() == copies


def test_search_finds_rows_that_came_after_the_text_index(spark):
    path = started(spark, [row(1)])
    write_text_index(spark, path)
    merge_store(spark, path, frame(spark, [row(1), row(1, text="zebra crossing")]))
    flt = ReportFilter(description_contains="zebra")
    assert flt.apply(read_store(spark, path, flt)).count() == 1


def test_only_months_of_the_span_are_read(spark):
    path = started(spark, [row(d) for d in range(0, 300, 5)])
    plan = missing_rows(read_store(spark, path), frame(spark, [row(40), row(45)]))._jdf.queryExecution().executedPlan().toString()
    assert "(txn_month#" in plan and ">= 2024-02" in plan and "<= 2024-02" in plan


def test_a_merge_shuffles_new_rows_once_behind_the_count(spark, monkeypatch):
    from tally.sources import merge
    path = started(spark, [row(1)])
    plans = []

    def write(blocks, to, mode, spread, behind):
        plans.append(behind(blocks.withColumn("txn_month", F.date_format("date", "yyyy-MM")).hint("rebalance", "txn_month", *spread))
                     ._jdf.queryExecution().optimizedPlan().toString())
        return write_store(blocks, to, mode, spread, behind)

    monkeypatch.setattr(merge, "write_store", write)
    merge_store(spark, path, frame(spark, [row(1), row(1), row(1), row(2)]))
    assert plans[0].count("RebalancePartitions") == 1
    assert plans[0].index("Generate") < plans[0].index("RebalancePartitions")  # copies are made behind it
    assert counted(read_store(spark, path)) == Counter({row(1): 3, row(2): 1})
