"""Array documents and their lines on disk: what they take, how they are cut and read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tally.plans import queries
from tally.plans.queries import ROW_COLS, _array_documents
from tally.session import scratch_dir, shuffles_removed
from tally.sources import ingest
from tally.sources.ingest import read_json


def files_below(folder):
    folder = folder.removeprefix("file:")
    return [f"{d}/{f}" for d, _, names in os.walk(folder) for f in names if f.startswith("part-")]


def orders(spark, n, description="x"):
    texts = [F.lit(description if c == "description" else "x").alias(c) for c in ROW_COLS[4:]]
    return spark.range(n).select((F.col("id") / 4).cast("bigint").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
                                 F.lit("2025-01-02").cast("timestamp_ntz").alias("date"), F.lit(1).cast("decimal(18,2)").alias("amount"), *texts)


@pytest.fixture
def splits(spark):
    def set_(most, cost):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
        spark.conf.set("spark.sql.files.openCostInBytes", str(cost))

    yield set_
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_documents_and_lines_take_a_part_of_their_text(spark, monkeypatch):
    """What the query leaves on disk: documents, lines, and no shuffle files of either."""
    folders, cut = [], ingest.array_lines
    monkeypatch.setattr(queries, "ledger", lambda spark, sf: orders(spark, 4000, "a description"))
    monkeypatch.setattr(queries, "read_json", lambda spark, path: folders.append(path) or read_json(spark, path))
    monkeypatch.setattr(ingest, "array_lines", lambda *a: folders.append(cut(*a)) or folders[-1])
    found = queries._array_ledger(spark, "")
    assert found.count() == 4000 and found.select("l_orderkey", "l_linenumber").distinct().count() == 4000
    for folder in folders:
        text = sum(len(r["value"]) for r in spark.read.text(folder, wholetext=True).collect())
        assert text > 600_000 and sum(os.path.getsize(f) for f in files_below(folder)) < text / 4


def test_shuffle_files_go_with_their_query(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shuffles_removed(spark):
        assert spark.conf.get(key) == "true" != before
        raise ZeroDivisionError
    assert spark.conf.get(key) == before


def test_documents_are_cut_evenly_by_their_text(spark):
    docs = [r["value"] for r in _array_documents(orders(spark, 6000, "d" * 1000)).collect()]
    rows = [len(json.loads(d)) for d in docs]
    assert sum(rows) == 6000 and max(rows) - min(rows) <= 1 and max(map(len, docs)) <= 700_000 + 4
    assert sorted((r["l_orderkey"], r["l_linenumber"]) for d in docs for r in json.loads(d)) == [(i // 4, i % 4) for i in range(6000)]


def test_null_keys_are_in_documents(spark):
    rows = orders(spark, 20).withColumn("l_linenumber", F.expr("if(l_linenumber = 2, null, l_linenumber)"))
    docs = [json.loads(r["value"]) for r in _array_documents(rows.withColumn("l_orderkey", F.expr("nullif(l_orderkey, 3)"))).collect()]
    assert sum(map(len, docs)) == 20 and sum("l_orderkey" not in r for d in docs for r in d) == 4


def test_files_that_are_never_cut_beside_those_that_may_be(spark, splits):
    folder = scratch_dir(spark, "ranges").removeprefix("file:")
    os.makedirs(folder)
    want = []
    for n, length in enumerate([1, 400, 30, 2]):
        part = [{"id": f"{n}.{i}", "s": "]}{[\"\\" * (i % 3)} for i in range(length)]
        want += part
        with open(f"{folder}/{n}.json", "w") as f:
            json.dump(part, f, indent=1)
    splits(1000, 300)
    got = [json.loads(r) for r in read_json(spark, folder).toJSON().collect()]
    assert sorted(got, key=lambda r: r["id"]) == sorted(want, key=lambda r: r["id"])


def test_only_files_that_may_be_cut_are_read_for_their_starts(spark, splits, monkeypatch):
    from tally.sources import json_ranges
    seen, starts = [], json_ranges._starts
    monkeypatch.setattr(json_ranges, "_starts", lambda found: seen.append(found.count()) or starts(found))
    folder = scratch_dir(spark, "ranges").removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w") as f:
        json.dump([{"a": "x" * 50}] * 100, f)
    splits(1 << 20, 1 << 20)
    assert read_json(spark, folder).count() == 100 and seen == [0]
    splits(1000, 1)
    assert read_json(spark, folder).count() == 100 and seen[1] > 5
