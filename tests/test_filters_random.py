"""ReportFilter / TxnFilter vs a Python model of the original filter rules."""

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest

from tally.operators.filters import ReportFilter, TxnFilter
from tally.schema import TXN_SCHEMA

WORDS = ["Shop A", "shop b", "CAFE", "Cafe.Bar", "rail-1", "", None, "Ünïcode Mart"]
CATS = ["Food", "food", "RENT", "", None, "Travel"]
PATTERNS = ["shop", "^cafe", r"\.", "a$", "[0-9]", "ünï", "mart|rail"]


def gen(rnd, n=120):
    base = datetime(2024, 1, 1)
    return [(None if rnd.random() < 0.1 else base + timedelta(days=rnd.randint(0, 60), hours=rnd.choice([0, 9])),
             rnd.choice(WORDS), None if rnd.random() < 0.1 else D(rnd.randint(-9000, 9000)) / 100,
             rnd.choice(CATS), rnd.choice(["Chk", "sav", None]), rnd.choice(WORDS), rnd.choice(WORDS))
            for _ in range(n)]


def keep(f: ReportFilter, r) -> bool:
    d, desc, a, cat, acct, merch, notes = r

    def search(pat, text):
        return text is not None and re.search(pat, text, re.IGNORECASE) is not None
    if f.start_date and not (d is not None and d >= datetime.fromisoformat(f.start_date)):
        return False
    if f.end_date and not (d is not None and d <= datetime.fromisoformat(f.end_date)):
        return False
    if f.min_amount is not None and not (a is not None and a >= D(str(f.min_amount))):
        return False
    if f.max_amount is not None and not (a is not None and a <= D(str(f.max_amount))):
        return False
    if f.categories and not (cat is not None and cat.lower() in {c.lower() for c in f.categories}):
        return False
    if f.exclude_categories and cat is not None and cat.lower() in {c.lower() for c in f.exclude_categories}:
        return False
    if f.merchants and not search("|".join(f.merchants), merch):
        return False
    if f.exclude_merchants and search("|".join(f.exclude_merchants), merch):
        return False
    if f.accounts and not (acct is not None and acct.lower() in {x.lower() for x in f.accounts}):
        return False
    if f.description_contains and not search(f.description_contains, desc):
        return False
    if f.notes_contains and not search(f.notes_contains, notes):
        return False
    return True


def keep_txn(f: TxnFilter, r) -> bool:
    _, desc, a, cat, _, merch, _ = r
    a = a if a is not None else D(0)
    if f.min_amount is not None and not a >= D(str(f.min_amount)):
        return False
    if f.max_amount is not None and not a <= D(str(f.max_amount)):
        return False
    if f.category and (cat or "").lower() != f.category.lower():
        return False
    if f.merchant and f.merchant.lower() not in (merch or "").lower():
        return False
    if f.description and f.description.lower() not in (desc or "").lower():
        return False
    return True


def random_filter(rnd) -> ReportFilter:
    pick = lambda xs: rnd.sample(xs, rnd.randint(1, 2)) if rnd.random() < 0.4 else None
    return ReportFilter(
        start_date=rnd.choice([None, "2024-01-10"]), end_date=rnd.choice([None, "2024-02-15"]),
        min_amount=rnd.choice([None, -20.5, 0]), max_amount=rnd.choice([None, 40, -0.01]),
        categories=pick(["food", "RENT", ""]), exclude_categories=pick(["FOOD", "travel"]),
        merchants=pick(PATTERNS), exclude_merchants=pick(PATTERNS), accounts=pick(["CHK", "Sav"]),
        description_contains=rnd.choice([None] + PATTERNS), notes_contains=rnd.choice([None] + PATTERNS))


@pytest.mark.parametrize("seed", range(6))
def test_random_filters(spark, seed):
    rnd = random.Random(seed)
    rows = gen(rnd)
    df = spark.createDataFrame(rows, TXN_SCHEMA).withColumn("i", __import__("pyspark.sql.functions",
                                                                           fromlist=["x"]).monotonically_increasing_id())
    indexed = [tuple(r) for r in df.collect()]
    for _ in range(4):
        f = random_filter(rnd)
        got = sorted(r.i for r in f.apply(df).select("i").collect())
        want = sorted(r[7] for r in indexed if keep(f, r[:7]))
        assert got == want, f
        t = TxnFilter(min_amount=rnd.choice([None, -5]), max_amount=rnd.choice([None, 10]),
                      category=rnd.choice([None, "FOOD", ""]), merchant=rnd.choice([None, "a", "."]),
                      description=rnd.choice([None, "shop", "ü"]))
        got = sorted(r.i for r in t.apply(df).select("i").collect())
        want = sorted(r[7] for r in indexed if keep_txn(t, r[:7]))
        assert got == want, t
