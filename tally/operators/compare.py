"""Multi-period P&L comparison in one pass.

Each named period is a [start, end] date range (midnight-inclusive end, as
the report filter). Up to ``WIDE_PERIODS`` periods become pairs of
conditional sums in a single global aggregate (partial per task, one final
row), unpivoted to one row per period. More periods are answered from prefix
sums: the rows are first summed per day (apart for midnight, which alone counts
on a period's last day), and a period is the running sum at its end less the one
before its start. The bounds of the periods take part in the order of the running
sums, so no row is joined, however long the periods are and however much they
overlap; the window holds at most two rows per day and two per period. An empty
range yields zeros. Only rows between the first start and the last end
are read; on a stored table that prunes its month folders.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.money import dsum, is_expense, is_income, to_double
from tally.operators.filters import ReportFilter, apply_filters, date_range

WIDE_PERIODS = 32


def _ts(d: str):
    return F.lit(f"{d} 00:00:00").cast("timestamp_ntz")


def period_comparison(df: DataFrame, periods: Sequence[tuple[str, str, str]],
                      flt: ReportFilter | None = None) -> DataFrame:
    if not periods:
        raise ValueError("at least one period is required")
    bounds = date_range(df.columns, min(s for _, s, _ in periods), max(e for _, _, e in periods))
    f = apply_filters(df, flt).where(reduce(lambda a, b: a & b, bounds))
    sums = _wide(f, periods) if len(periods) <= WIDE_PERIODS else _by_prefix(f, periods)
    return sums.select("period", "start_date", "end_date",
                       to_double(F.col("inc")).alias("income"),
                       to_double(F.col("exp")).alias("expenses"),
                       to_double(F.col("inc") - F.col("exp")).alias("net_income"))


def _wide(f: DataFrame, periods) -> DataFrame:
    date, amt = F.col("date"), F.col("amount")
    aggs = []
    for i, (_, start, end) in enumerate(periods):
        inside = (date >= _ts(start)) & (date <= _ts(end))
        aggs.append(dsum(F.when(inside & is_income(), amt)).alias(f"i{i}"))
        aggs.append(F.abs(dsum(F.when(inside & is_expense(), amt))).alias(f"e{i}"))
    wide = f.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(label).alias("period"), F.lit(start).alias("start_date"),
                 F.lit(end).alias("end_date"), F.col(f"i{i}").alias("inc"),
                 F.col(f"e{i}").alias("exp"))
        for i, (label, start, end) in enumerate(periods)])
    return wide.select(F.inline(rows))


def _by_prefix(f: DataFrame, periods) -> DataFrame:
    amt, day = F.col("amount"), F.to_date("date")
    later = (F.col("date") > day.cast("timestamp_ntz")).cast("int")
    sums = f.select(day.alias("day"), later.alias("later"), "amount").groupBy("day", "later") \
        .agg(dsum(F.when(is_income(), amt)).alias("i"), dsum(F.when(is_expense(), amt)).alias("e")) \
        .withColumn("place", F.lit(1))
    spans = f.sparkSession.createDataFrame([(n, *p) for n, p in enumerate(periods)],
                                           "n int, period string, start_date string, end_date string")
    start, end = F.to_date("start_date"), F.to_date("end_date")
    sign = F.when(start <= end, 1).otherwise(0)
    # the start asks before the sums of its midnight, the end behind them
    bounds = spans.select("*", F.inline(F.array(
        F.struct(start.alias("day"), F.lit(0).alias("place"), (-sign).alias("sign")),
        F.struct(end.alias("day"), F.lit(2).alias("place"), sign.alias("sign"))))).withColumn("later", F.lit(0))
    zero = F.lit(0).cast("decimal(28,2)")
    line = Window.orderBy("day", "later", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sums.unionByName(bounds, allowMissingColumns=True).withColumns(
        {c: F.sum(F.coalesce(c, zero)).over(line) for c in ("i", "e")}).where(F.col("n").isNotNull())
    return upto.groupBy("n", "period", "start_date", "end_date").agg(
        F.sum(F.col("sign") * F.col("i")).alias("inc"), F.abs(F.sum(F.col("sign") * F.col("e"))).alias("exp"))
