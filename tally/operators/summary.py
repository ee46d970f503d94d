"""Summary statistics of the downloader and the describe() view of amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.money import dsum, to_double
from tally.operators.base import Report
from tally.operators.quantiles import quantile_summary
from tally.operators.stats import mean

QUARTILES = (0.25, 0.5, 0.75)


MEDIAN_METHODS = ("select", "percentile", "approx")


def summary_statistics(df: DataFrame, median: str = "select") -> Report:
    """total_transactions counts rows; the other fields ignore null amounts;
    total_amount is 0 over no amounts, the rest are null then.

    ``median``:
      select      exact; ``tally.operators.quantiles`` reads the input once,
                  into distinct amounts with their counts, and never builds a
                  single-task value map (default; scales with any data).
      percentile  exact in one read with Spark's ``percentile``: its final
                  merge holds every distinct amount in one task; fastest when
                  the input is expensive to re-read and amounts are few.
      approx      ``percentile_approx`` (rank error ≤ n/10000), one read.
    """
    if median not in MEDIAN_METHODS:
        raise ValueError(f"median must be one of {MEDIAN_METHODS}")
    if median != "select":
        amt = F.col("amount")
        s, n = dsum(amt), F.count(amt)
        med = (F.percentile(to_double(amt), F.lit(0.5)) if median == "percentile"
               else F.percentile_approx(to_double(amt), 0.5, 10000))
        header = lambda: df.agg(F.count(F.lit(1)).alias("total_transactions"),
                        to_double(s).alias("total_amount"), mean(s, n).alias("average_amount"),
                        to_double(F.min(amt)).alias("min_amount"),
                        to_double(F.max(amt)).alias("max_amount"),
                        med.alias("median_amount"))
        return Report("summary", header, lambda: summary_by_category(df))
    def header() -> DataFrame:
        qs = quantile_summary(df, "amount", [0.5], ["median_amount"])
        s, n = F.col("s"), F.col("n")
        return qs.select(F.col("rows").alias("total_transactions"),
                         to_double(s).alias("total_amount"), mean(s, n).alias("average_amount"),
                         to_double(F.col("mn")).alias("min_amount"),
                         to_double(F.col("mx")).alias("max_amount"), "median_amount")
    return Report("summary", header, lambda: summary_by_category(df))


def summary_by_category(df: DataFrame) -> DataFrame:
    """category → total and *size* (rows, null amounts included)."""
    return (df.where(F.col("category").isNotNull()).groupBy("category")
              .agg(to_double(dsum(F.col("amount"))).alias("total"),
                   F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("total").desc(), F.col("category").asc()))


def top_categories(df: DataFrame, n: int = 5) -> DataFrame:
    return summary_by_category(df).limit(n)


def describe_amounts(df: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles, max of amount (exact quartiles,
    same plan as the summary median)."""
    qs = quantile_summary(df, "amount", QUARTILES, ["p25", "p50", "p75"])
    s, n = F.col("s"), F.col("n")
    return qs.select(n.alias("count"), mean(s, n).alias("mean"),
                     F.col("sd").alias("std"),
                     to_double(F.col("mn")).alias("min"), "p25", "p50", "p75",
                     to_double(F.col("mx")).alias("max"))
