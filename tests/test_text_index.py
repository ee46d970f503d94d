"""Trigram index of the store: necessary conditions, skipped files, equal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from tally.functions.patterns import _equal
from tally.functions.trigrams import fold, leaves, required, trigrams
from tally.operators.filters import ReportFilter
from tally.session import scratch_dir
from tally.sources.store import read_store, row_columns, write_store
from tally.sources.text_index import TEXT_COLUMNS, _file, _trigrams, files_left, write_text_index


def test_fold_covers_every_equal_character():
    every = "".join(map(chr, (c for c in range(0x20000) if not 0xD800 <= c < 0xE000)))
    for c in range(128):
        found = set(re.findall(re.escape(chr(c)), every, re.IGNORECASE)) | {chr(x) for x in _equal(c, re.IGNORECASE)}
        assert {fold(x) for x in found} == {fold(chr(c))}


@pytest.mark.parametrize("pattern, want", [
    ("Coffee", ("all", "cof", "off", "ffe", "fee")),
    ("ab", ("all",)),
    ("abc|de", ("all",)),
    ("abc|xyz", ("all", ("any", ("all", "abc"), ("all", "xyz")))),
    ("a(?:bc)+d", ("all", "abc")),
    ("(ab){2}", ("all", "aba", "bab")),
    ("abx?cde", ("all", "cde")),
    ("ab[xy]cde", ("all", "cde")),
    (r"^ab\bcd$", ("all", "abc", "bcd")),
    ("(?!abc)def", ("all", "def")),
    ("caféteria", ("all", "caf", "ter", "eri", "ria")),
    ("", ("all",)),
])
def test_required(pattern, want):
    assert required(pattern) == want


def _holds(condition, text):
    if isinstance(condition, str):
        return condition in text
    return (all if condition[0] == "all" else any)(_holds(c, text) for c in condition[1:])


def test_required_is_necessary():
    rng = random.Random(5)
    atoms = ["a", "k", "K", "s", "ak", "ska", "é", ".", "[as]", r"\b", "^", "$", "(?=a)", "(?!s)"]

    def build(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(atoms) if depth == 0 or rng.random() < 0.6 else f"({'|'.join(build(depth - 1) for _ in range(rng.randint(1, 3)))})"
            if rng.random() < 0.3 and p not in ("^", "$", r"\b") and not p.startswith("(?"):
                p = f"(?:{p}){rng.choice(['*', '+', '?', '{2}', '{1,3}', '{,2}', '*?'])}"
            parts.append(p)
        return "".join(parts)

    letters, hits = "aaakkkssAKSéKſ ", 0
    for _ in range(9000):
        pattern = build(1)
        search, condition = re.compile(pattern, re.IGNORECASE), required(pattern)
        for _ in range(10):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
            if search.search(text):
                hits += bool(leaves(condition))
                assert _holds(condition, fold(text)), (pattern, text)
    assert hits > 200


ROWS = [("1998-01-03 00:00:00", "Blue Bottle Coffee", "flat white", None), ("1998-01-04 00:00:00", "Grocer", None, "weekly"),
        ("1998-02-01 00:00:00", "Grocer", "apples", "WEEKly"), ("1998-03-01 00:00:00", "Café Ünder", "", "urgent: pay"),
        ("1998-04-01 00:00:00", None, None, None), (None, "coffee stand", "no date", "x")]


@pytest.fixture(scope="module")
def store(spark):
    df = spark.createDataFrame(ROWS, "date string, merchant string, description string, notes string") \
        .selectExpr("cast(date as timestamp_ntz) date", "merchant", "description", "notes", "cast(1 as decimal(18,2)) amount")
    path = write_store(df, scratch_dir(spark, "t-text-index"))
    write_text_index(spark, path)
    return path


@pytest.mark.parametrize("flt, n_files", [
    (ReportFilter(merchants=["coffee"]), 2),
    (ReportFilter(merchants=["coffee", "caf. .nder"]), None),
    (ReportFilter(merchants=["coffee", "caf\\w .nder"]), 3),
    (ReportFilter(notes_contains="weekly"), 2),
    (ReportFilter(description_contains="^apples$|WHITE"), 2),
    (ReportFilter(merchants=["grocer"], notes_contains="urgent"), 0),
    (ReportFilter(exclude_merchants=["coffee"]), None),
    (ReportFilter(merchants=["a"]), None),
    (ReportFilter(start_date="1998-01-04", merchants=["coffee"]), 2),
])
def test_files_and_rows(spark, store, flt, n_files):
    files = files_left(spark, store, flt)
    if n_files is not None:
        assert len(files) == n_files
    got = flt.apply(read_store(spark, store, flt))
    want = flt.apply(read_store(spark, store))
    assert got.schema == want.schema
    assert rows_of(got.select(row_columns(got))) == rows_of(want.select(row_columns(want)))
    if files:
        assert len(got.inputFiles()) <= len(files)


def test_marked_trigrams_are_those_of_the_texts(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "ab", "".join(rng.choice("aAbKKſSİıié日 \\x00z#0") for _ in range(rng.randint(0, 12)))])
    path = scratch_dir(spark, "t-trigrams")
    spark.createDataFrame([(i, text(), text(), None) for i in range(700)], "i int, merchant string, description string, notes string") \
        .repartition(5, "i").write.parquet(path)
    files = spark.read.parquet(path).coalesce(1).select(_file().alias("file"), *TEXT_COLUMNS)
    got = files.mapInArrow(_trigrams, "file string, name string, trigram string")
    want = files.unpivot("file", list(TEXT_COLUMNS), "name", "text").selectExpr("*").select("file", "name", F.explode(trigrams(F.col("text"))).alias("trigram"))
    assert got.count() < want.count()  # a row for each place before
    assert rows_of(got.distinct()) == rows_of(want.distinct()) and got.count() == got.distinct().count()


def test_unknown_files_are_read(spark, store):
    path = scratch_dir(spark, "t-text-index-more")
    df = read_store(spark, store)
    write_store(df.select(row_columns(df)), path)
    flt = ReportFilter(merchants=["bakery"])
    assert files_left(spark, path, flt) is None  # no index at all
    write_text_index(spark, path)
    assert files_left(spark, path, flt) == [] and flt.apply(read_store(spark, path, flt)).count() == 0
    more = df.select(row_columns(df)).where("merchant = 'Grocer'").replace("Grocer", "Bakery")
    write_store(more, path, "append")
    assert flt.apply(read_store(spark, path, flt)).count() == 2
    write_store(more, path, "overwrite")
    assert files_left(spark, path, flt) is None
