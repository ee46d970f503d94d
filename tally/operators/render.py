"""Formatted text lines of the six report layouts, as DataFrame columns.

Each ``*_lines`` function projects the (small, aggregated) report rows to
one text line per row with JVM-side string functions, so rendering never
collects rows to the driver. ``report_text`` adds the fixed header/footer
lines for printing a whole report.

Fixed layouts (Python format specs of the original text reports):
  P&L category line   "    {category:30} {total:>15} ({pct:.1f}%)"
  cash flow line      "{period:<15} {inflow:>15} {outflow:>15} {net:>15} {balance:>20}"
  category line       "{category:<25} {total:>15} {count:>8} {avg:>15} {min:>15} {max:>15} {pct:>7.1f}%"
  merchant line       "{merchant[:30]:<30} {total:>15} {count:>8} {avg:>15} {category[:20]:<20} {pct:>7.1f}%"
  trend line          "{period:<15} {income:>15} {expenses:>15} {net:>15} {count:>8} {top[:25]:<25}"
  account line        "{account[:30]:<30} {income:>15} {expenses:>15} {change:>15} {count:>8}"
Money is "$" + thousands separators + 2 decimals; a missing top category
reads "N/A".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.money import format_currency as cur
from tally.functions.money import format_fixed, pad_left, pad_right, truncate


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _join(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def pnl_category_lines(details: DataFrame, share: str, keep=()) -> DataFrame:
    line = F.concat(F.lit("    "), pad_right(F.col("category"), 30), F.lit(" "),
                    pad_left(cur(F.col("total")), 15),
                    F.lit(" ("), format_fixed(F.col(share), 1), F.lit("%)"))
    return details.select(*keep, "category", line.alias("line"))


def cash_flow_lines(details: DataFrame) -> DataFrame:
    line = _join(pad_right(F.col("period"), 15), pad_left(cur(F.col("inflow")), 15),
                 pad_left(cur(F.col("outflow")), 15), pad_left(cur(F.col("net_flow")), 15),
                 pad_left(cur(F.col("running_balance")), 20))
    return details.select("period", line.alias("line"))


def category_lines(details: DataFrame) -> DataFrame:
    line = F.concat(_join(pad_right(F.col("category"), 25), pad_left(cur(F.col("total")), 15),
                          pad_left(_s("count"), 8), pad_left(cur(F.col("average")), 15),
                          pad_left(cur(F.col("min")), 15), pad_left(cur(F.col("max")), 15),
                          pad_left(format_fixed(F.col("percentage_of_total"), 1), 7)),
                    F.lit("%"))
    return details.select("category", line.alias("line"))


def merchant_lines(details: DataFrame) -> DataFrame:
    line = F.concat(_join(pad_right(truncate(F.col("merchant"), 30), 30),
                          pad_left(cur(F.col("total")), 15), pad_left(_s("count"), 8),
                          pad_left(cur(F.col("average")), 15),
                          pad_right(truncate(F.col("primary_category"), 20), 20),
                          pad_left(format_fixed(F.col("percentage_of_total"), 1), 7)),
                    F.lit("%"))
    return details.select("merchant", line.alias("line"))


def trend_lines(details: DataFrame) -> DataFrame:
    top = F.coalesce(F.col("top_expense_category"), F.lit("N/A"))
    line = _join(pad_right(F.col("period"), 15), pad_left(cur(F.col("income")), 15),
                 pad_left(cur(F.col("expenses")), 15), pad_left(cur(F.col("net")), 15),
                 pad_left(_s("transaction_count"), 8), pad_right(truncate(top, 25), 25))
    return details.select("period", line.alias("line"))


def account_lines(details: DataFrame) -> DataFrame:
    line = _join(pad_right(truncate(F.col("account"), 30), 30), pad_left(cur(F.col("income")), 15),
                 pad_left(cur(F.col("expenses")), 15), pad_left(cur(F.col("balance_change")), 15),
                 pad_left(_s("transaction_count"), 8))
    return details.select("account", line.alias("line"))


def net_label(net: Column) -> Column:
    """'NET INCOME' when net >= 0 else 'NET LOSS', followed by |net|."""
    return F.concat(F.when(net >= 0, F.lit("NET INCOME")).otherwise(F.lit("NET LOSS")),
                    F.lit(":       "), cur(F.abs(net)))


def pnl_text(report) -> list[str]:
    """Whole P&L text (header + category lines); the detail frames are small
    (one row per category), so this is the only driver-side collect."""
    h = report.header.select(
        "period",
        cur(F.col("total_income")).alias("inc"), "income_transaction_count",
        cur(F.col("total_expenses")).alias("exp"), "expense_transaction_count",
        net_label(F.col("net_income")).alias("net")).first()
    inc = [r.line for r in pnl_category_lines(report.sections["income_by_category"],
                                              "percentage_of_income").collect()]
    exp = [r.line for r in pnl_category_lines(report.sections["expenses_by_category"],
                                              "percentage_of_expenses").collect()]
    out = ["", "=" * 80, "PROFIT & LOSS REPORT", f"Period: {h.period}", "=" * 80,
           "", "INCOME:", f"  Total Income:    {h.inc}",
           f"  Transactions:    {h.income_transaction_count}"]
    if inc:
        out += ["", "  Income by Category:"] + inc
    out += ["", "EXPENSES:", f"  Total Expenses:  {h.exp}",
            f"  Transactions:    {h.expense_transaction_count}"]
    if exp:
        out += ["", "  Expenses by Category:"] + exp
    out += ["", "-" * 80, h.net, "=" * 80, ""]
    return out


def _lines(df: DataFrame) -> list[str]:
    return [r.line for r in df.select("line").collect()]


def write_text(report, path: str, mode: str = "errorifexists") -> str:
    """Lines of a report's list as text files, in report order over the files
    (each task writes its range of the sorted lines); nothing passes the driver."""
    lines = {"cash_flow": cash_flow_lines, "category_analysis": category_lines, "merchant_analysis": merchant_lines,
             "trend_analysis": trend_lines, "account_summary": account_lines}[report.kind](report.details)
    lines.select("line").write.mode(mode).text(path)
    return path


def cash_flow_text(report) -> list[str]:
    h = report.header.first()
    out = ["", "=" * 100, f"CASH FLOW REPORT ({h.grouping.upper()})", f"Period: {h.period}", "=" * 100,
           "", f"{'Period':<15} {'Inflow':>15} {'Outflow':>15} {'Net Flow':>15} {'Running Balance':>20}",
           "-" * 100]
    out += _lines(cash_flow_lines(report.details))
    t = report.header.select(pad_left(cur(F.col("total_inflow")), 15).alias("i"),
                             pad_left(cur(F.col("total_outflow")), 15).alias("o"),
                             pad_left(cur(F.col("net_cash_flow")), 15).alias("n")).first()
    out += ["-" * 100, f"{'TOTAL':<15} {t.i} {t.o} {t.n}", "=" * 100, ""]
    return out


def category_text(report) -> list[str]:
    top_n = report.top_n
    h = report.header.select(pad_left(cur(F.col("total_amount")), 15).alias("t"), "category_count").first()
    out = ["", "=" * 120, "CATEGORY ANALYSIS REPORT"] + ([f"Top {top_n} Categories"] if top_n else [])
    out += ["=" * 120, "", f"{'Category':<25} {'Total':>15} {'Count':>8} {'Average':>15} {'Min':>15} "
            f"{'Max':>15} {'%':>8}", "-" * 120]
    out += _lines(category_lines(report.details))
    out += ["-" * 120, f"{'TOTAL':<25} {h.t} ({h.category_count} categories)", "=" * 120, ""]
    return out


def merchant_text(report) -> list[str]:
    top = f" (Top {report.top_n})" if report.top_n else ""
    out = ["", "=" * 110, f"MERCHANT/PAYEE ANALYSIS REPORT{top}", "=" * 110, "",
           f"{'Merchant':<30} {'Total':>15} {'Count':>8} {'Average':>15} {'Category':<20} {'%':>8}",
           "-" * 110]
    return out + _lines(merchant_lines(report.details)) + ["=" * 110, ""]


def trend_text(report) -> list[str]:
    g = report.header.first().grouping
    out = ["", "=" * 110, f"TREND ANALYSIS REPORT ({g.upper()})", "=" * 110, "",
           f"{'Period':<15} {'Income':>15} {'Expenses':>15} {'Net':>15} {'Txns':>8} "
           f"{'Top Expense Category':<25}", "-" * 110]
    return out + _lines(trend_lines(report.details)) + ["=" * 110, ""]


def account_text(report) -> list[str]:
    """All accounts. A list that may not fit the driver is written in parts by
    ``write_text`` instead."""
    t = report.header.select(pad_left(cur(F.col("total_balance_change")), 15).alias("t")).first().t
    out = ["", "=" * 100, "ACCOUNT SUMMARY REPORT", "=" * 100, "",
           f"{'Account':<30} {'Income':>15} {'Expenses':>15} {'Net Change':>15} {'Txns':>8}", "-" * 100]
    out += _lines(account_lines(report.details))
    out += ["-" * 100, f"{'TOTAL':<30} {'':>15} {'':>15} {t}", "=" * 100, ""]
    return out


def report_text(report) -> list[str]:
    """Text layout of any of the six report kinds."""
    return {"profit_and_loss": pnl_text, "cash_flow": cash_flow_text, "category_analysis": category_text,
            "merchant_analysis": merchant_text, "trend_analysis": trend_text,
            "account_summary": account_text}[report.kind](report)
