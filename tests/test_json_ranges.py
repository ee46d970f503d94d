"""Array documents read in byte ranges."""

import json
import os
import random

import pytest

from tally.session import scratch_dir
from tally.sources.ingest import read_json


def put(folder, name, text):
    folder = folder.removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as f:
        f.write(text)
    return folder


TEXT = ['"', "\\", "}", "{", "[", "]", ",", "é", "日", " ", "\n", "\t", "a", "b", "\\\"", "😀", ":"]


def documents(rng, rows):
    def text(most):
        return "".join(rng.choice(TEXT) for _ in range(rng.randint(0, most)))

    return [{"id": str(i), "s": text(60), "o": {"p": text(9), "q": [text(9), text(9)], "r": {"x": text(5), "y": {"z": "}" * rng.randint(0, 3)}}}} for i in range(rows)]


def small_ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def ranges(spark):
    yield lambda size: small_ranges(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("size", "indent", "ascii_only"), [(37, None, False), (200, 2, False), (1000, None, True), (1 << 20, 1, False)])
def test_ranges_give_all_elements(spark, ranges, size, indent, ascii_only):
    rng = random.Random(size)
    rows = documents(rng, 60)
    folder = scratch_dir(spark, "ranges")
    for name, part in (("a.json", rows[:50]), ("b.json", rows[50:51]), ("c.json", rows[51:])):
        put(folder, name, ("\n " * rng.randint(0, 3)) + json.dumps(part, indent=indent, ensure_ascii=ascii_only) + rng.choice(["", "\n", " \n\n"]))
    ranges(size)
    assert size > 500 or spark.read.option("lineSep", "}").text(folder).rdd.getNumPartitions() > 20
    got = sorted(read_json(spark, folder).toJSON().map(json.loads).collect(), key=lambda r: int(r["id"]))
    assert got == rows


def test_one_element_over_many_ranges(spark, ranges):
    rows = [{"a": "1"}, {"a": "}" * 3000 + "\"{[", "b": {"c": "x" * 2000}}, {"a": "3"}]
    folder = put(scratch_dir(spark, "ranges"), "a.json", json.dumps(rows))
    ranges(100)
    got = sorted(read_json(spark, folder).toJSON().map(json.loads).collect(), key=lambda r: len(r["a"]))
    assert got == [rows[0], rows[2], rows[1]]


def test_folders_that_are_columns(spark, ranges):
    folder = scratch_dir(spark, "ranges")
    put(f"{folder}/year=2024", "a.json", json.dumps([{"a": f"x{i}" * 9} for i in range(20)]))
    put(f"{folder}/year=2025", "a.json", json.dumps([{"a": "z"}]))
    ranges(64)
    got = read_json(spark, folder).groupBy("year").count().collect()
    assert {(r["year"], r["count"]) for r in got} == {(2024, 20), (2025, 1)}


@pytest.mark.parametrize("text", ['[{"a": "1"}, ]', '[{"a": "1"} {"a": "2"}]x', '[{"a": "1"}', '[{"a": "1"}] []', '[{"a": "1}]', '[1, 2]', '[[{"a": "1"}]]',
                                  '[{"a": "x\ny"}]', '[{"a": "1"},, {"a": "2"}]', '[{"a": oops}]'])
def test_malformed_documents_fail(spark, text):
    folder = put(scratch_dir(spark, "ranges"), "a.json", text)
    with pytest.raises(ValueError, match="malformed"):
        read_json(spark, folder).collect()


def test_empty_documents(spark):
    folder = scratch_dir(spark, "ranges")
    put(folder, "a.json", " [ ]\n")
    assert read_json(spark, folder).count() == 0
    put(folder, "b.json", '[{"a": "1"}]')
    assert [r["a"] for r in read_json(spark, folder).collect()] == ["1"]


def test_documents_hold_many_orders_and_bounded_lines(spark):
    from pyspark.sql import functions as F

    from tally.plans.queries import ROW_COLS, _array_documents
    texts = [F.lit("x").alias(c) for c in ROW_COLS[4:]]
    rows = spark.range(4096 * 2).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
                                        F.lit(None).cast("timestamp_ntz").alias("date"), F.lit(1).cast("decimal(18,2)").alias("amount"), *texts)
    sizes = [len(json.loads(r["value"])) for r in _array_documents(rows).collect()]
    assert sizes == [4096, 4096]
    assert _array_documents(rows.withColumn("l_linenumber", (F.col("l_orderkey") % 64).cast("int"))).count() == 4
