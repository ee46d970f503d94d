"""Money arithmetic and text formatting as column expressions.

Sums stay DECIMAL (exact, independent of task order) and are cast to
DOUBLE only at the output edge. Formatting uses ``format_number`` (exact
binary value, half-even), which matches Python's ``format`` on floats;
``format_string`` would round 0.125 up to 0.13.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero() -> Column:
    return F.lit(0).cast("decimal(18,2)")


def amount() -> Column:
    return F.col("amount")


def is_income(c: Column | None = None) -> Column:
    return (amount() if c is None else c) > 0


def is_expense(c: Column | None = None) -> Column:
    return (amount() if c is None else c) < 0


def dsum(c: Column) -> Column:
    """Exact sum that is 0 (not null) over no rows."""
    return F.coalesce(F.sum(c), zero())


def to_double(c: Column) -> Column:
    return c.cast("double")


def ratio_pct(part: Column, whole: Column, guard: Column | None = None) -> Column:
    """abs(part)/abs(whole)*100 in double; 0 when the guard (whole != 0) fails.

    ANSI division by zero raises, so the guard is required.
    """
    g = (whole != 0) if guard is None else guard
    return F.when(g, F.abs(to_double(part)) / F.abs(to_double(whole)) * F.lit(100.0)) \
            .otherwise(F.lit(0.0))


def format_currency(c: Column) -> Column:
    """``$1,234.50``; negative amounts read ``$-5.00``."""
    return F.concat(F.lit("$"), F.format_number(c.cast("double"), 2))


def format_fixed(c: Column, digits: int) -> Column:
    """Fixed decimals without grouping separators (Python ``{:.Nf}``)."""
    return F.regexp_replace(F.format_number(c.cast("double"), digits), ",", "")


def format_percent(c: Column, digits: int = 1) -> Column:
    return F.concat(format_fixed(c, digits), F.lit("%"))


def pad_right(c: Column, width: int) -> Column:
    """Python ``{s:<w}``: pad to ``width``, never truncate."""
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def pad_left(c: Column, width: int) -> Column:
    """Python ``{s:>w}``: pad to ``width``, never truncate."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, " "))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
