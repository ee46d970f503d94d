"""Custom report: filtered rows, optionally sorted or grouped by any column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.money import dsum, to_double
from tally.operators.base import Report
from tally.operators.filters import ReportFilter, apply_filters


@dataclass(frozen=True)
class ReportSort:
    field: str
    order: str = "desc"

    def __post_init__(self):
        if self.order not in ("asc", "desc"):
            raise ValueError("order must be 'asc' or 'desc'")


def sort_rows(df: DataFrame, sort: ReportSort | None) -> DataFrame:
    """Sort on one field, nulls last either way; an unknown field leaves the
    rows as they are. Remaining columns break ties so the order is total."""
    from tally.sources.ingest import source_columns
    from tally.sources.store import row_columns
    df = df.select(*row_columns(df))
    if sort is None or sort.field not in source_columns(df):
        return df
    key = F.col(sort.field)
    first = key.asc_nulls_last() if sort.order == "asc" else key.desc_nulls_last()
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c != sort.field]
    return df.orderBy(first, *rest)


def custom_report(df: DataFrame, flt: ReportFilter | None = None,
                  sort: ReportSort | None = None, group_by: str | None = None) -> Report:
    """Grouped: one row per non-null key (key ascending) with total, count,
    average, min, max; the sort does not apply. Ungrouped: the filtered rows
    in sort order. The header has the total and row count of all filtered rows.
    """
    from tally.sources.ingest import source_columns
    f = apply_filters(df, flt)
    def header():
        return f.agg(to_double(dsum(F.col("amount"))).alias("total_amount"),
                     F.count(F.lit(1)).alias("transaction_count"))
    if group_by and group_by in source_columns(f):
        amt = F.col("amount")
        s, n = dsum(amt), F.count(amt)
        details = lambda: (f.where(F.col(group_by).isNotNull()).groupBy(group_by)
                   .agg(to_double(s).alias("total"), n.alias("count"),
                        F.when(n > 0, to_double(s) / n).alias("average"),
                        to_double(F.min(amt)).alias("min"),
                        to_double(F.max(amt)).alias("max"))
                   .orderBy(group_by))
        return Report("custom", lambda: header().withColumn("grouped_by", F.lit(group_by)), details)
    return Report("custom", header, lambda: sort_rows(f, sort))
