"""Profit & loss: totals, income by category, expenses by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.money import dsum, is_expense, is_income, ratio_pct, to_double
from tally.functions.periods import period_description
from tally.operators.base import Report
from tally.operators.filters import ReportFilter, apply_filters

SIGN = "sign"


def sign_category(df: DataFrame) -> DataFrame:
    """(sign, category) → exact sum, count, rows: the one aggregation of P&L.

    ``sign`` is 'income' (> 0), 'expense' (< 0) or null (zero/null amount);
    the null category stays a group here so the totals include its rows.
    The result has at most 3 × (categories + 1) rows.
    """
    amt = F.col("amount")
    sign = F.when(is_income(), F.lit("income")).when(is_expense(), F.lit("expense"))
    return (df.select(sign.alias(SIGN), "category", "amount")
              .groupBy(SIGN, "category")
              .agg(dsum(amt).alias("s"), F.count(amt).alias("n"),
                   F.count(F.lit(1)).alias("rows")))


def category_sides(sc: DataFrame) -> DataFrame:
    """Both P&L category lists in one frame (``section`` income/expenses).

    Shares divide by the side's total over the aggregated rows of that side,
    null category included: a window partitioned by sign over at most
    categories + 1 rows per side.
    """
    tot = F.abs(F.sum("s").over(Window.partitionBy(SIGN)))
    total = F.abs(F.col("s"))
    return (sc.where(F.col(SIGN).isNotNull())
              .select(SIGN, "category", "s", "n", tot.alias("tot"))
              .where(F.col("category").isNotNull())
              .select(F.when(F.col(SIGN) == "income", F.lit("income")).otherwise(F.lit("expenses"))
                       .alias("section"),
                      "category",
                      to_double(total).alias("total"),
                      F.col("n").alias("count"),
                      F.abs(to_double(F.col("s")) / F.col("n")).alias("average"),
                      ratio_pct(total, F.col("tot"), F.col("tot") > 0).alias("percentage")))


def side_by_category(sc: DataFrame, side: str, share_name: str) -> DataFrame:
    """One P&L list from the rows of ``sign_category``: share over the side's
    total (null category included) with a window over ≤ categories + 1
    aggregated rows; the final sort then runs inside that single partition
    (no range exchange)."""
    g = sc.where(F.col(SIGN) == side).select("category", "s", "n")
    tot = F.abs(F.sum("s").over(Window.partitionBy()))
    total = F.abs(F.col("s"))
    return (g.select("category", "s", "n", tot.alias("tot"))
             .where(F.col("category").isNotNull())
             .select("category", to_double(total).alias("total"), F.col("n").alias("count"),
                     F.abs(to_double(F.col("s")) / F.col("n")).alias("average"),
                     ratio_pct(total, F.col("tot"), F.col("tot") > 0).alias(share_name))
             .orderBy(F.col("total").desc(), F.col("category").asc()))


def profit_and_loss(df: DataFrame, flt: ReportFilter | None = None, materialize: bool = False) -> Report:
    """All frames come from one aggregate of at most 3 × (categories + 1) rows.
    ``materialize`` writes it to the checkpoint folder first, so that a job
    that writes several frames reads the input once."""
    flt = flt or ReportFilter()
    sc = sign_category(apply_filters(df, flt))
    if materialize:
        from tally.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        sc = sc.checkpoint()
    inc = dsum(F.when(F.col(SIGN) == "income", F.col("s")))
    exp = F.abs(dsum(F.when(F.col(SIGN) == "expense", F.col("s"))))
    header = lambda: sc.agg(
        F.lit(period_description(flt.start_date, flt.end_date)).alias("period"),
        to_double(inc).alias("total_income"),
        to_double(exp).alias("total_expenses"),
        to_double(inc - exp).alias("net_income"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("transaction_count"),
        F.coalesce(F.sum(F.when(F.col(SIGN) == "income", F.col("rows"))), F.lit(0))
         .alias("income_transaction_count"),
        F.coalesce(F.sum(F.when(F.col(SIGN) == "expense", F.col("rows"))), F.lit(0))
         .alias("expense_transaction_count"),
    )
    return Report("profit_and_loss", header, None, {
        "income_by_category": lambda: side_by_category(sc, "income", "percentage_of_income"),
        "expenses_by_category": lambda: side_by_category(sc, "expense", "percentage_of_expenses"),
        "by_category": lambda: category_sides(sc),
    })
