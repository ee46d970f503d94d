"""Radix descent to exact quantiles: values of one bucket, widths, ties, edges."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tally.operators import quantiles as Q
from tally.operators.quantiles import BUCKET_BITS, ROUND_BITS, quantile_summary, rounds

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
NAMES = [f"p{i}" for i in range(len(PROBS))]


def plain(values, p):
    values = sorted(values)
    if not values:
        return None
    at = (len(values) - 1) * float(p)
    lo, hi = int(at // 1), int(-(-at // 1))
    a, b = float(values[lo]), float(values[hi])
    return a if lo == hi or a == b else (hi - at) * a + (at - lo) * b


def check(spark, values, kind="decimal(18,2)"):
    df = spark.createDataFrame([(None if v is None else str(v),) for v in values], "t string").select(F.col("t").cast(kind).alias("x"))
    got = quantile_summary(df, "x", PROBS, NAMES).first()
    there = [v for v in values if v is not None]
    assert [got[n] for n in NAMES] == [plain(there, p) for p in PROBS]
    assert (got["rows"], got["n"], got["s"]) == (len(values), len(there), sum(there, Decimal(0)))


def test_rounds_use_up_the_longest_shift():
    for precision in range(1, 19):
        longest = (10 ** precision - 1).bit_length() - BUCKET_BITS - 1
        assert rounds(precision) * ROUND_BITS >= longest and (rounds(precision) - 1) * ROUND_BITS < max(longest, 1)


@pytest.mark.parametrize("top", [10 ** 3, 10 ** 9, 10 ** 17])
def test_random_values(spark, top):
    rng = random.Random(top)
    values = [Decimal(rng.randint(-top, top)) / 100 for _ in range(1500)]
    check(spark, values + values[:400] + [None] * 30)


def test_values_that_share_all_but_their_last_bits(spark):
    """All in one bucket of the histogram, and most in one of the next rounds."""
    rng = random.Random(3)
    check(spark, [Decimal(10 ** 16 + rng.randint(0, 4000)) / 100 for _ in range(900)] +
          [Decimal(-10 ** 16 - rng.randint(0, 2 ** 30)) / 100 for _ in range(900)])


@pytest.mark.parametrize("values", [[], [None, None], [Decimal("0.00")], [None, Decimal("-7.25")],
                                    [Decimal("9999999999999999.99"), Decimal("-9999999999999999.99")],
                                    [Decimal("-0.01"), Decimal("0.00"), Decimal("0.01")], [Decimal("123456789.01")] * 50])
def test_edges(spark, values):
    check(spark, values)


def test_a_task_orders_few_rows_of_a_bucket(spark):
    """A hundred thousand different values of one bucket: each window's rows are at most
    2 ** ROUND_BITS for a bucket that is left."""
    df = spark.range(200_000).select((F.lit(2 ** 45) + F.col("id")).cast("decimal(18,0)").alias("x"))
    got = quantile_summary(df, "x", [0.5], ["m"])
    assert got.first()["m"] == 2 ** 45 + 99_999.5
    vals = Q.value_counts(df, "x")
    first = vals.groupBy("k", Q.prefix(F.col("u"), F.col("k"), 0)).count()
    assert first.count() <= 2 ** BUCKET_BITS and first.agg(F.max("count")).first()[0] > 2 ** ROUND_BITS
    for done in range(1, rounds(18) + 1):
        parts = vals.groupBy("k", Q.prefix(F.col("u"), F.col("k"), done - 1).alias("up")) \
            .agg(F.count_distinct(Q.prefix(F.col("u"), F.col("k"), done)).alias("parts"))
        assert parts.agg(F.max("parts")).first()[0] <= 2 ** ROUND_BITS
