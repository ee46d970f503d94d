"""Report filters and list filters as single Column predicates.

``ReportFilter`` predicates (ANDed into one ``where``):
- start/end date: ``date >= start`` and ``date <= end`` at midnight, so later
  times on the end day are excluded unless ``end_inclusive_day`` is set;
- min/max amount: plain comparisons (null amounts drop);
- categories / accounts: case-insensitive membership (null drops);
- exclude_categories: negated membership, null **kept**;
- merchants / description_contains / notes_contains: case-insensitive
  regex search (null drops); exclude_merchants: negated, null kept.
Unset, empty-string and empty-list values mean "no filter", except the
amount bounds, where only ``None`` means unset. A filter on a column the
source does not have is skipped.

``TxnFilter`` is the list filter of the downloader: a missing amount counts
as 0, a missing text as ''; category is case-insensitive equality and
merchant/description are case-insensitive *literal* substrings.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Iterable, Optional, Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.patterns import java_pattern

# Columns that only the stored table has (tally.sources.store): its partition
# column and lower-cased text, so that these filters reach the scan.
MONTH, CATEGORY_LC, ACCOUNT_LC = "txn_month", "category_lc", "account_lc"
STORE_COLUMNS = (MONTH, CATEGORY_LC, ACCOUNT_LC)


def _ts(d: str) -> Column:
    return F.lit(f"{d} 00:00:00").cast("timestamp_ntz")


def date_range(columns: Iterable[str], start: Optional[str], end: Optional[str],
               whole_end_day: bool = False) -> list[Column]:
    """Bounds on ``date`` and, on a stored table, on its month folders. The end
    is midnight of ``end`` unless ``whole_end_day`` takes in all of that day."""
    cols, preds = set(columns), []
    if "date" not in cols:
        return preds
    if start:
        preds.append(F.col("date") >= _ts(start))
        if MONTH in cols:
            preds.append(F.col(MONTH) >= start[:7])
    if end:
        preds.append(F.col("date") < F.date_add(_ts(end), 1).cast("timestamp_ntz") if whole_end_day
                     else F.col("date") <= _ts(end))
        if MONTH in cols:
            preds.append(F.col(MONTH) <= end[:7])
    return preds


def _dec(x) -> Column:
    return F.lit(Decimal(str(x)))


def _lower_list(values: Iterable[str]) -> list[str]:
    return sorted({v.lower() for v in values})


def regex_search(c: Column, pattern: str) -> Column:
    """Case-insensitive search as Python's ``re`` does it; null text → false."""
    return F.coalesce(c.rlike(java_pattern(pattern)), F.lit(False))


def check_pattern(pattern: str) -> str:
    """Compile on the driver so a bad pattern fails before any job starts."""
    java_pattern(pattern)
    return pattern


def check_java_pattern(spark, pattern: str) -> None:
    """Compile with the JVM's own classes too, so that what Java cannot run (such
    as a lookbehind without a bound) fails before any job as well."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except IllegalArgumentException as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e


@dataclass(frozen=True)
class ReportFilter:
    start_date: Optional[str] = None
    end_date: Optional[str] = None
    categories: Optional[Sequence[str]] = None
    merchants: Optional[Sequence[str]] = None
    accounts: Optional[Sequence[str]] = None
    min_amount: Optional[float] = None
    max_amount: Optional[float] = None
    description_contains: Optional[str] = None
    notes_contains: Optional[str] = None
    exclude_categories: Optional[Sequence[str]] = None
    exclude_merchants: Optional[Sequence[str]] = None
    end_inclusive_day: bool = False

    def __post_init__(self):
        for p in self.patterns():
            check_pattern(p)

    def patterns(self) -> list[str]:
        """Every pattern, and those of a list also joined, as they are searched for."""
        lists = [m for m in (self.merchants, self.exclude_merchants) if m]
        return [*(p for m in lists for p in (*m, "|".join(m))),
                *(p for p in (self.description_contains, self.notes_contains) if p)]

    def predicates(self, columns: Iterable[str]) -> list[Column]:
        cols = set(columns)
        preds: list[Column] = []
        has = cols.__contains__
        preds += date_range(cols, self.start_date, self.end_date, self.end_inclusive_day)
        category = F.col(CATEGORY_LC) if has(CATEGORY_LC) else F.lower("category")
        account = F.col(ACCOUNT_LC) if has(ACCOUNT_LC) else F.lower("account")
        if self.min_amount is not None and has("amount"):
            preds.append(F.col("amount") >= _dec(self.min_amount))
        if self.max_amount is not None and has("amount"):
            preds.append(F.col("amount") <= _dec(self.max_amount))
        if self.categories and has("category"):
            preds.append(category.isin(_lower_list(self.categories)))
        if self.exclude_categories and has("category"):
            preds.append(~F.coalesce(category.isin(_lower_list(self.exclude_categories)), F.lit(False)))
        if self.merchants and has("merchant"):
            preds.append(regex_search(F.col("merchant"), "|".join(self.merchants)))
        if self.exclude_merchants and has("merchant"):
            preds.append(~regex_search(F.col("merchant"), "|".join(self.exclude_merchants)))
        if self.accounts and has("account"):
            preds.append(account.isin(_lower_list(self.accounts)))
        if self.description_contains and has("description"):
            preds.append(regex_search(F.col("description"), self.description_contains))
        if self.notes_contains and has("notes"):
            preds.append(regex_search(F.col("notes"), self.notes_contains))
        return preds

    def apply(self, df: DataFrame) -> DataFrame:
        from tally.sources.ingest import source_columns
        for p in self.patterns():
            check_java_pattern(df.sparkSession, p)
        preds = self.predicates(source_columns(df))
        return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def apply_filters(df: DataFrame, flt: Optional[ReportFilter]) -> DataFrame:
    return (flt or ReportFilter()).apply(df)


@dataclass(frozen=True)
class TxnFilter:
    min_amount: Optional[float] = None
    max_amount: Optional[float] = None
    category: Optional[str] = None
    merchant: Optional[str] = None
    description: Optional[str] = None

    def predicates(self) -> list[Column]:
        amt = F.coalesce(F.col("amount"), F.lit(0).cast("decimal(18,2)"))
        preds = []
        if self.min_amount is not None:
            preds.append(amt >= _dec(self.min_amount))
        if self.max_amount is not None:
            preds.append(amt <= _dec(self.max_amount))
        if self.category:
            preds.append(F.lower(F.coalesce(F.col("category"), F.lit(""))) == self.category.lower())
        if self.merchant:
            preds.append(F.lower(F.coalesce(F.col("merchant"), F.lit("")))
                         .contains(self.merchant.lower()))
        if self.description:
            preds.append(F.lower(F.coalesce(F.col("description"), F.lit("")))
                         .contains(self.description.lower()))
        return preds

    def apply(self, df: DataFrame) -> DataFrame:
        preds = self.predicates()
        return df.where(reduce(lambda a, b: a & b, preds)) if preds else df
