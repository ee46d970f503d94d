"""Cash flow by period: inflow, outflow, net and running balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.money import dsum, is_expense, is_income, to_double
from tally.functions.periods import key_label, period_key
from tally.operators.base import Report
from tally.operators.filters import ReportFilter, apply_filters


def period_frame(df: DataFrame, grouping: str, *cols: str) -> DataFrame:
    """Rows with a ``pkey`` (first day of their period, null without a date).
    Labels are attached after aggregation."""
    return df.select(period_key(F.col("date"), grouping).alias("pkey"), *cols)


def dated(per: DataFrame) -> DataFrame:
    """Aggregated rows of real periods; rows without a date have none."""
    return per.where(F.col("pkey").isNotNull())


def undated_count(rows: str = "transaction_count"):
    """How many rows the periods leave out, over aggregated rows."""
    return F.coalesce(F.sum(F.when(F.col("pkey").isNull(), F.col(rows))), F.lit(0)).alias("undated_count")


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """A short list (a row per period) sorted in one task: no sampling job as
    for a sort by ranges."""
    return rows.repartition(1).sortWithinPartitions(key)


def cash_flow_periods(df: DataFrame, grouping: str = "monthly") -> DataFrame:
    """One row per period with exact DECIMAL inflow/outflow/net.

    A single partial+final hash aggregate on ``period``; zero and null
    amounts count as transactions but belong to neither flow. Rows without
    a date are one more group, with a null ``pkey``.
    """
    amt = F.col("amount")
    return (period_frame(df, grouping, "amount")
            .groupBy("pkey")
            .agg(dsum(F.when(is_income(), amt)).alias("inflow"),
                 F.abs(dsum(F.when(is_expense(), amt))).alias("outflow"),
                 F.count(F.lit(1)).alias("transaction_count"))
            .withColumn("period", key_label(F.col("pkey"), grouping)))


def cash_flow_details(per: DataFrame, *more: str) -> DataFrame:
    """Report rows of ``cash_flow_periods``, in period order, and ``more`` columns.

    The running balance is a window over the aggregated periods only: at most
    one row per period label (3,650 for ten years of days), so the single
    ordered partition it needs stays small at any data size."""
    run = Window.orderBy("pkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    net = F.col("inflow") - F.col("outflow")
    return per.select(
        "period",
        to_double(F.col("inflow")).alias("inflow"),
        to_double(F.col("outflow")).alias("outflow"),
        to_double(net).alias("net_flow"),
        to_double(F.sum(net).over(run)).alias("running_balance"),
        "transaction_count", *more,
    ).orderBy("period")


def cash_flow(df: DataFrame, flt: ReportFilter | None = None,
              grouping: str = "monthly") -> Report:
    every = cash_flow_periods(apply_filters(df, flt), grouping)
    details = lambda: cash_flow_details(dated(every))
    has = F.col("pkey").isNotNull()
    header = lambda: every.agg(
        F.lit(grouping).alias("grouping"),
        F.coalesce(F.concat(F.min("period"), F.lit(" to "), F.max("period")), F.lit("")).alias("period"),
        to_double(dsum(F.when(has, F.col("inflow")))).alias("total_inflow"),
        to_double(dsum(F.when(has, F.col("outflow")))).alias("total_outflow"),
        to_double(dsum(F.when(has, F.col("inflow"))) - dsum(F.when(has, F.col("outflow")))).alias("net_cash_flow"),
        F.count("pkey").alias("period_count"), undated_count(),
    )
    return Report("cash_flow", header, details)
