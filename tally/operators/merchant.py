"""Merchant analysis: totals per merchant with its primary (mode) category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.money import dsum, ratio_pct, to_double
from tally.operators.base import Report
from tally.operators.filters import ReportFilter, apply_filters

DEFAULT_TOP_N = 20


def merchant_category(df: DataFrame) -> DataFrame:
    """(merchant, category) → exact sum, count of amounts, rows.

    Pre-aggregating on the pair keeps the mode computation skew-safe: a
    merchant holding a third of all rows becomes one partial row per task
    and category before the shuffle, never a list of raw rows in one task.
    """
    amt = F.col("amount")
    return (df.groupBy("merchant", "category")
              .agg(dsum(amt).alias("s"), F.count(amt).alias("n"),
                   F.count(F.lit(1)).alias("rows")))


def mode_category():
    """Aggregate over (merchant, category) rows: the most frequent non-null
    category (ties: smallest name), '' when there is none."""
    cand = F.when(F.col("category").isNotNull(),
                  F.struct((-F.col("rows")).alias("k"), F.col("category").alias("c")))
    return F.coalesce(F.min(cand).getField("c"), F.lit(""))


def primary_category(mc: DataFrame) -> DataFrame:
    """merchant → primary category, merchants without a name excluded."""
    return (mc.where(F.col("merchant").isNotNull()).groupBy("merchant")
              .agg(mode_category().alias("primary_category")))


def merchant_totals(mc: DataFrame) -> DataFrame:
    return (mc.where(F.col("merchant").isNotNull())
              .groupBy("merchant")
              .agg(dsum(F.col("s")).alias("s"), F.sum("n").alias("n"),
                   mode_category().alias("primary_category")))


def merchant_analysis(df: DataFrame, flt: ReportFilter | None = None,
                      top_n: int | None = DEFAULT_TOP_N) -> Report:
    """Sorted by |total| descending (ties: merchant ascending), first
    ``top_n`` (None = all). Shares divide by |grand total| of all filtered
    rows, merchants without a name included.

    Plan: (merchant, category) partial aggregate → ``rollup(merchant)`` over
    those pre-aggregated rows, which adds the grand-total row in the same
    aggregation (no second scan) → one top-(N+1) with the total row ordered
    first → the share is a window over those N+1 rows.

    With ``top_n=None`` (all merchants) the rollup's total row is joined
    back to the merchants (by the grouping id, a one-row broadcast): no
    window partition holds all merchants, and both sides read the same
    exchange of the pre-aggregated rows, so the input is still read once.
    """
    if top_n is not None and top_n < 1:
        raise ValueError("top_n must be >= 1")
    mc = merchant_category(apply_filters(df, flt))
    def details() -> DataFrame:
        m = (mc.rollup("merchant")
               .agg(dsum(F.col("s")).alias("s"), F.sum("n").alias("n"),
                    mode_category().alias("primary_category"), F.grouping_id().alias("gid")))
        is_total = F.col("gid") == 1
        if top_n:
            ranked = (m.where(is_total | F.col("merchant").isNotNull())
                       .orderBy(is_total.desc(), F.abs(F.col("s")).desc(), F.col("merchant").asc())
                       .limit(top_n + 1))
            with_total = ranked.withColumn("g", F.max(F.when(is_total, F.col("s")))
                                           .over(Window.partitionBy()))
        else:
            # both sides use all columns of the rollup, and no condition is pushed below it:
            # else their exchanges would differ, and each would scan the input
            whole = F.struct((F.col("gid") - 1).alias("of"), "s", "n", "primary_category")
            total = m.agg(F.max(F.when(is_total, whole)).alias("t")).select(F.col("t.of").alias("of"), F.col("t.s").alias("g"))
            with_total = m.join(F.broadcast(total), F.col("gid") == F.col("of")) \
                .where(F.when(F.col("of").isNotNull(), F.col("merchant").isNotNull()))
        s, n = F.col("s"), F.coalesce(F.col("n"), F.lit(0))
        return with_total.where(~is_total).select(
            "merchant",
            to_double(s).alias("total"),
            n.alias("count"),
            F.when(n > 0, to_double(s) / n).alias("average"),
            "primary_category",
            ratio_pct(s, F.col("g")).alias("percentage_of_total"),
        ).orderBy(F.abs(F.col("total")).desc(), F.col("merchant").asc())

    header = lambda: mc.agg(
        to_double(F.coalesce(F.sum("s"), F.lit(0))).alias("total_amount"),
        F.least(F.countDistinct("merchant"),
                F.lit(top_n) if top_n else F.countDistinct("merchant")).alias("merchant_count"),
    )
    return Report("merchant_analysis", header, details, top_n=top_n)
