"""ReportSpec: one validated description of a report request.

It carries the HTTP/CLI parameter surface of the original tool and checks
the same bounds before any Spark job is planned:
  dates 'YYYY-MM-DD'; last_days 1..3650; amounts within ±1e9 and
  max_amount >= min_amount; strings ≤ 500 characters; lists ≤ 100 items;
  top_n 1..1000; report_type / grouping / sort order from fixed sets;
  regex patterns must compile.
``run(df)`` builds the lazy report on a normalized transactions frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Optional, Sequence

from pyspark.sql import DataFrame

from tally.functions.periods import GROUPINGS
from tally.operators.account import account_summary
from tally.operators.base import Report
from tally.operators.cash_flow import cash_flow
from tally.operators.category import category_analysis
from tally.operators.custom import ReportSort, custom_report
from tally.operators.filters import ReportFilter, TxnFilter, apply_filters
from tally.operators.merchant import DEFAULT_TOP_N, merchant_analysis
from tally.operators.pnl import profit_and_loss
from tally.operators.trend import trend
from tally.sources.acquire import acquire

# Report names and parameter bounds of the request models.
REPORT_TYPES = ("profit_loss", "cash_flow", "category_analysis", "merchant_analysis",
                "trend_analysis", "account_summary", "custom")
MAX_DAYS = 3650
MAX_ABS_AMOUNT = 1_000_000_000
MAX_TEXT = 500
MAX_LIST = 100
MAX_TOP_N = 1000


def _check_date(name: str, v: Optional[str]) -> None:
    if v:
        try:
            datetime.strptime(v, "%Y-%m-%d")
        except ValueError as e:
            raise ValueError(f"{name} {v!r} is not a date like 2025-01-31") from e


@dataclass(frozen=True)
class ReportSpec:
    report_type: str
    start_date: Optional[str] = None
    end_date: Optional[str] = None
    last_days: Optional[int] = None
    as_of: Optional[str] = None
    min_amount: Optional[float] = None
    max_amount: Optional[float] = None
    categories: Optional[Sequence[str]] = None
    exclude_categories: Optional[Sequence[str]] = None
    merchants: Optional[Sequence[str]] = None
    exclude_merchants: Optional[Sequence[str]] = None
    accounts: Optional[Sequence[str]] = None
    description_contains: Optional[str] = None
    notes_contains: Optional[str] = None
    grouping: str = "monthly"
    top_n: Optional[int] = None
    sort_field: Optional[str] = None
    sort_order: str = "desc"
    group_by: Optional[str] = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        if self.report_type not in REPORT_TYPES:
            raise ValueError(f"report_type must be one of {REPORT_TYPES}")
        if self.grouping not in GROUPINGS:
            raise ValueError(f"grouping must be one of {GROUPINGS}")
        if self.sort_order not in ("asc", "desc"):
            raise ValueError("sort_order must be 'asc' or 'desc'")
        for n in ("start_date", "end_date", "as_of"):
            _check_date(n, getattr(self, n))
        if self.last_days is not None and not 1 <= self.last_days <= MAX_DAYS:
            raise ValueError(f"last_days must be within 1..{MAX_DAYS}")
        for n in ("min_amount", "max_amount"):
            v = getattr(self, n)
            if v is not None and not -MAX_ABS_AMOUNT <= v <= MAX_ABS_AMOUNT:
                raise ValueError(f"{n} must be within ±{MAX_ABS_AMOUNT}")
        if self.min_amount is not None and self.max_amount is not None \
                and self.max_amount < self.min_amount:
            raise ValueError(f"max_amount {self.max_amount} is below min_amount {self.min_amount}")
        for n in ("description_contains", "notes_contains", "sort_field", "group_by"):
            v = getattr(self, n)
            if v is not None and len(v) > MAX_TEXT:
                raise ValueError(f"{n} longer than {MAX_TEXT} characters")
        for n in ("categories", "exclude_categories", "merchants", "exclude_merchants", "accounts"):
            v = getattr(self, n)
            if v is not None:
                if len(v) > MAX_LIST:
                    raise ValueError(f"{n}: at most {MAX_LIST} items")
                if any(len(x) > MAX_TEXT for x in v):
                    raise ValueError(f"{n}: item longer than {MAX_TEXT} characters")
        if self.top_n is not None and not 1 <= self.top_n <= MAX_TOP_N:
            raise ValueError(f"top_n must be within 1..{MAX_TOP_N}")
        self.to_filter()  # compiles the regex patterns

    def to_filter(self) -> ReportFilter:
        return ReportFilter(
            start_date=self.start_date, end_date=self.end_date,
            categories=self.categories, merchants=self.merchants, accounts=self.accounts,
            min_amount=self.min_amount, max_amount=self.max_amount,
            description_contains=self.description_contains, notes_contains=self.notes_contains,
            exclude_categories=self.exclude_categories, exclude_merchants=self.exclude_merchants)

    def run(self, df: DataFrame, materialize: bool = False) -> Report:
        """The report on ``df``. ``last_days`` picks the rows to report on (whole
        days, as an acquisition does); dates given beside it filter those.
        ``materialize`` is for jobs that write several frames of one report."""
        if self.last_days is not None:
            df = acquire(df, days=self.last_days, as_of=self.as_of)
        f = self.to_filter()
        t = self.report_type
        if t == "profit_loss":
            return profit_and_loss(df, f, materialize)
        if t == "cash_flow":
            return cash_flow(df, f, self.grouping)
        if t == "category_analysis":
            return category_analysis(df, f, self.top_n)
        if t == "merchant_analysis":
            return merchant_analysis(df, f, self.top_n or DEFAULT_TOP_N)
        if t == "trend_analysis":
            return trend(df, f, self.grouping)
        if t == "account_summary":
            return account_summary(df, f)
        sort = ReportSort(self.sort_field, self.sort_order) if self.sort_field else None
        return custom_report(df, f, sort, self.group_by)


class Reports:
    """Builder over one transactions frame, one method per report."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def materialize(cls, df: DataFrame, path: str, mode: str = "errorifexists") -> "Reports":
        """Write ``df`` once to the month-partitioned store and report on that.

        Several reports over one source then share a single coercion/join
        pass; their date filters prune partitions of the stored table.
        """
        from tally.sources.store import read_store, write_store
        write_store(df, path, mode)
        return cls(read_store(df.sparkSession, path))

    def run(self, spec: ReportSpec) -> Report:
        return spec.run(self.df)

    def profit_and_loss(self, filters: ReportFilter | None = None) -> Report:
        return profit_and_loss(self.df, filters)

    def cash_flow(self, filters: ReportFilter | None = None, grouping: str = "monthly") -> Report:
        return cash_flow(self.df, filters, grouping)

    def category_analysis(self, filters: ReportFilter | None = None,
                          top_n: int | None = None) -> Report:
        return category_analysis(self.df, filters, top_n)

    def merchant_analysis(self, filters: ReportFilter | None = None,
                          top_n: int | None = DEFAULT_TOP_N) -> Report:
        return merchant_analysis(self.df, filters, top_n)

    def trend_analysis(self, filters: ReportFilter | None = None, grouping: str = "monthly") -> Report:
        return trend(self.df, filters, grouping)

    def account_summary(self, filters: ReportFilter | None = None) -> Report:
        return account_summary(self.df, filters)

    def custom_report(self, filters: ReportFilter | None = None, sort: ReportSort | None = None,
                      group_by: str | None = None) -> Report:
        return custom_report(self.df, filters, sort, group_by)

    def summary(self, filters: ReportFilter | None = None, median: str = "select",
                rows: TxnFilter | None = None) -> Report:
        """Summary of the rows that pass the report filter and the list filter."""
        from tally.operators.summary import summary_statistics
        return summary_statistics((rows or TxnFilter()).apply(apply_filters(self.df, filters)), median)

    def describe(self, filters: ReportFilter | None = None) -> DataFrame:
        from tally.operators.summary import describe_amounts
        return describe_amounts(apply_filters(self.df, filters))

    def period_comparison(self, periods, filters: ReportFilter | None = None) -> DataFrame:
        from tally.operators.compare import period_comparison
        return period_comparison(self.df, periods, filters)
