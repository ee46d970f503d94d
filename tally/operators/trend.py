"""Trend by period: income, expenses, net, count and top expense category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.money import dsum, is_expense, is_income, to_double
from tally.operators.base import Report
from tally.functions.periods import key_label
from tally.operators.cash_flow import dated, in_order, period_frame, undated_count
from tally.operators.filters import ReportFilter, apply_filters


def trend(df: DataFrame, flt: ReportFilter | None = None, grouping: str = "monthly") -> Report:
    """Two aggregation steps, both map-side combined:

    1. (period, category) → income sum, expense sum, rows;
    2. period → totals and the arg-min category: the category with the most
       negative expense sum, ties → smallest name, via ``min(struct(sum, cat))``.
    Step 1 bounds step 2's input to periods × categories, so one hot
    category or period never funnels raw rows into one task.
    """
    amt = F.col("amount")
    pc = (period_frame(apply_filters(df, flt), grouping, "category", "amount")
          .groupBy("pkey", "category")
          .agg(dsum(F.when(is_income(), amt)).alias("inc"),
               F.sum(F.when(is_expense(), amt)).alias("exp"),
               F.count(F.lit(1)).alias("n")))
    cand = F.when(F.col("category").isNotNull() & F.col("exp").isNotNull(),
                  F.struct(F.col("exp").alias("s"), F.col("category").alias("c")))
    per = pc.groupBy("pkey").agg(
        dsum(F.col("inc")).alias("income"),
        F.abs(dsum(F.col("exp"))).alias("expenses"),
        F.sum("n").alias("transaction_count"),
        F.min(cand).getField("c").alias("top_expense_category"),
    )
    details = lambda: in_order(dated(per).select(
        key_label(F.col("pkey"), grouping).alias("period"),
        to_double(F.col("income")).alias("income"),
        to_double(F.col("expenses")).alias("expenses"),
        to_double(F.col("income") - F.col("expenses")).alias("net"),
        "transaction_count",
        "top_expense_category",
    ), "period")
    header = lambda: per.agg(F.lit(grouping).alias("grouping"), F.count("pkey").alias("period_count"), undated_count())
    return Report("trend_analysis", header, details)
