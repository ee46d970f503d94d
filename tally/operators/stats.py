"""Exact per-group statistics shared by the category and summary reports.

``moments`` aggregates sum, count, min, max and the sum of squares as
DECIMAL, so the sample standard deviation is computed from exact moments:
var = (n·Σx² − (Σx)²) / (n·(n−1)). Only the final quotient and square root
are floating point; the result does not depend on task order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally.functions.money import dsum, to_double


def moment_aggs(c: Column) -> list[Column]:
    return [dsum(c).alias("s"), F.count(c).alias("n"), F.min(c).alias("mn"),
            F.max(c).alias("mx"), F.sum(c * c).alias("sq")]


def mean(s: Column, n: Column) -> Column:
    """double(sum)/count; null when there are no values."""
    return F.when(n > 0, to_double(s) / n)


def stddev_samp(s: Column, n: Column, sq: Column) -> Column:
    """Sample std from exact moments; null below two values.

    Where n·Σx² or (Σx)² leaves DECIMAL(38), the sums are centred on the mean
    rounded to cents first: Σ(x−m)² = Σx² − 2mΣx + nm², less (Σx−nm)²/n. Both
    forms depend on the exact sums only, not on the order of tasks."""
    rows, total = n.cast("decimal(15,0)"), s
    num = F.try_subtract(F.try_multiply(rows, sq), F.try_multiply(total, total))
    plain = to_double(num) / (n.cast("double") * (n - 1).cast("double"))
    m = F.round(to_double(s) / n, 2).cast("decimal(18,2)")
    spread = sq - F.lit(2) * m * total + rows * m * m
    off = to_double(total - rows * m)
    centred = (to_double(spread) - off * off / n) / (n - 1).cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.coalesce(plain, centred), F.lit(0.0))))
