"""Period labels for time grouping (all JVM-side column expressions).

Fixed label formats:
  daily      2025-03-07
  weekly     2024-12-30/2025-01-05   (Monday/Sunday of the ISO week)
  monthly    2025-03
  quarterly  2025Q1
  yearly     2025
Labels sort as strings in period order, which the running balance relies on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUPINGS = ("daily", "weekly", "monthly", "quarterly", "yearly")


def week_start(date: Column) -> Column:
    return F.trunc(F.to_date(date), "week")


def period_label(date: Column, grouping: str) -> Column:
    if grouping == "daily":
        return F.date_format(date, "yyyy-MM-dd")
    if grouping == "weekly":
        ws = week_start(date)
        return F.concat(F.date_format(ws, "yyyy-MM-dd"), F.lit("/"),
                        F.date_format(F.date_add(ws, 6), "yyyy-MM-dd"))
    if grouping == "monthly":
        return F.date_format(date, "yyyy-MM")
    if grouping == "quarterly":
        return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
    if grouping == "yearly":
        return F.date_format(date, "yyyy")
    raise ValueError(f"grouping must be one of {GROUPINGS}, got {grouping!r}")


def period_key(date: Column, grouping: str) -> Column:
    """The first day of the date's period, as a DATE.

    Grouping on this key is cheap integer arithmetic per row; the string
    label is computed from it after aggregation, on one row per period.
    Keys sort in the same order as their labels.
    """
    if grouping == "daily":
        return F.to_date(date)
    if grouping == "weekly":
        return week_start(date)
    if grouping in ("monthly", "quarterly", "yearly"):
        return F.trunc(F.to_date(date), {"monthly": "month", "quarterly": "quarter",
                                         "yearly": "year"}[grouping])
    raise ValueError(f"grouping must be one of {GROUPINGS}, got {grouping!r}")


def key_label(key: Column, grouping: str) -> Column:
    """Label of a ``period_key`` value (same text as ``period_label``)."""
    return period_label(key, grouping)


def period_description(start_date: str | None, end_date: str | None) -> str:
    """Human-readable filter window of a P&L report."""
    if start_date and end_date:
        return f"{start_date} to {end_date}"
    if start_date:
        return f"From {start_date}"
    if end_date:
        return f"Until {end_date}"
    return "All time"
