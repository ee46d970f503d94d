"""Category analysis: per-category statistics and share of the grand total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.money import ratio_pct, to_double
from tally.operators.base import Report
from tally.operators.filters import ReportFilter, apply_filters
from tally.operators.stats import mean, moment_aggs, stddev_samp


def category_moments(df: DataFrame) -> DataFrame:
    """category → exact moments; the null category is kept as a group here
    because the grand total covers its rows too."""
    return df.groupBy("category").agg(*moment_aggs(F.col("amount")))


def category_analysis(df: DataFrame, flt: ReportFilter | None = None,
                      top_n: int | None = None) -> Report:
    """Sorted by total descending (ties: category ascending); ``top_n`` of
    None or 0 means all categories. Shares divide by |grand total| of all
    filtered rows, so they may exceed 100 %.
    """
    if top_n is not None and top_n < 0:
        raise ValueError("top_n must be >= 0")
    cm = category_moments(apply_filters(df, flt))
    # Grand total from the aggregated rows (one per category, null category
    # included), not from a second scan: a window over categories + 1 rows.
    grand = F.col("g")
    rows = (cm.withColumn("g", F.sum("s").over(Window.partitionBy()))
              .where(F.col("category").isNotNull())
              .orderBy(F.col("s").desc(), F.col("category").asc()))
    if top_n:
        rows = rows.limit(top_n)
    s, n = F.col("s"), F.col("n")
    details = lambda: rows.select(
        "category",
        to_double(s).alias("total"),
        n.alias("count"),
        mean(s, n).alias("average"),
        to_double(F.col("mn")).alias("min"),
        to_double(F.col("mx")).alias("max"),
        F.coalesce(stddev_samp(s, n, F.col("sq")), F.lit(0.0)).alias("std_dev"),
        ratio_pct(s, grand).alias("percentage_of_total"),
    ).orderBy(F.col("total").desc(), F.col("category").asc())
    header = lambda: cm.agg(
        to_double(F.coalesce(F.sum("s"), F.lit(0))).alias("total_amount"),
        F.least(F.count(F.col("category")), F.lit(top_n) if top_n else F.count(F.col("category")))
         .alias("category_count"),
    )
    return Report("category_analysis", header, details, top_n=top_n)
