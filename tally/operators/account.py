"""Account summary: income, expenses and balance change per account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.money import dsum, is_expense, is_income, to_double
from tally.operators.base import Report
from tally.operators.filters import ReportFilter, apply_filters


def account_summary(df: DataFrame, flt: ReportFilter | None = None) -> Report:
    """Rows without an account are not listed (and not in the total)."""
    amt = F.col("amount")
    per = (apply_filters(df, flt).where(F.col("account").isNotNull())
           .groupBy("account")
           .agg(dsum(F.when(is_income(), amt)).alias("inc"),
                F.abs(dsum(F.when(is_expense(), amt))).alias("exp"),
                F.count(F.lit(1)).alias("transaction_count")))
    change = F.col("inc") - F.col("exp")
    details = lambda: per.select(
        "account",
        to_double(F.col("inc")).alias("income"),
        to_double(F.col("exp")).alias("expenses"),
        to_double(change).alias("balance_change"),
        "transaction_count",
    ).orderBy(F.abs(F.col("balance_change")).desc(), F.col("account").asc())
    header = lambda: per.agg(to_double(dsum(change)).alias("total_balance_change"),
                     F.count(F.lit(1)).alias("account_count"))
    return Report("account_summary", header, details)
