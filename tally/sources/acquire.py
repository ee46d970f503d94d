"""Acquisition window and account-scoped reads.

The downloader's window rules: ``days`` (when the caller sets it) overrides
both dates with [as_of − days, as_of]; otherwise the end defaults to
``as_of`` and the start to 1 January of as_of's year. ``as_of`` is an
explicit argument (default: today) so runs are reproducible. Both ends are
whole days here: the window keeps every time on the end day.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators.filters import date_range


def acquisition_window(start_date: Optional[str] = None, end_date: Optional[str] = None,
                       days: Optional[int] = None, as_of: Optional[str] = None) -> tuple[str, str]:
    today = datetime.strptime(as_of, "%Y-%m-%d").date() if as_of else date.today()
    if days is not None:
        if days < 1:
            raise ValueError("days must be at least 1")
        return (today - timedelta(days=days)).isoformat(), today.isoformat()
    end = end_date or today.isoformat()
    start = start_date or f"{today.year}-01-01"
    return start, end


def acquire(df: DataFrame, start_date: Optional[str] = None, end_date: Optional[str] = None,
            account_id: Optional[str] = None, days: Optional[int] = None,
            as_of: Optional[str] = None) -> DataFrame:
    """Rows of the acquisition window (and account), as one pushed-down where."""
    start, end = acquisition_window(start_date, end_date, days, as_of)
    preds = date_range(df.columns, start, end, whole_end_day=True)
    if account_id:
        preds.append(F.col("account") == account_id)
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def by_account(df: DataFrame, account_id: str) -> DataFrame:
    return df.where(F.col("account") == account_id)


def list_accounts(df: DataFrame) -> DataFrame:
    """Accounts seen in the transactions, with row count and net amount."""
    return (df.where(F.col("account").isNotNull()).groupBy("account")
              .agg(F.count(F.lit(1)).alias("transaction_count"),
                   F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total_amount"))
              .orderBy("account"))


def list_categories(df: DataFrame) -> DataFrame:
    """Distinct non-null categories as written (case-sensitive; '' included)."""
    return df.select("category").where(F.col("category").isNotNull()).distinct().orderBy("category")
