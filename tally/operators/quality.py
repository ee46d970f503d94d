"""Valid/quarantine split of transaction rows by the request bounds.

Row rules, first failing rule is the reason:
  date_missing     date is null (absent or unparseable)
  amount_missing   amount is null (absent or unparseable)
  amount_range     |amount| > 1,000,000,000
  text_too_long    any text field longer than 500 characters
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.schema import TEXT_FIELDS

# Request bounds of the parameter validation.
MAX_ABS_AMOUNT = 1_000_000_000
MAX_TEXT = 500


def quality_reason(df: DataFrame) -> Column:
    too_long = F.lit(False)
    for c in TEXT_FIELDS:
        if c in df.columns:
            too_long = too_long | F.coalesce(F.length(c) > MAX_TEXT, F.lit(False))
    return (F.when(F.col("date").isNull(), F.lit("date_missing"))
             .when(F.col("amount").isNull(), F.lit("amount_missing"))
             .when(F.abs(F.col("amount")) > MAX_ABS_AMOUNT, F.lit("amount_range"))
             .when(too_long, F.lit("text_too_long")))


def with_quality(df: DataFrame) -> DataFrame:
    r = quality_reason(df)
    return df.withColumns({"quality": F.when(r.isNull(), F.lit("valid")).otherwise(F.lit("quarantine")),
                           "reason": r})


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    q = with_quality(df)
    return (q.where(F.col("quality") == "valid").drop("quality", "reason"),
            q.where(F.col("quality") == "quarantine"))


def quality_counts(df: DataFrame) -> DataFrame:
    return (with_quality(df).groupBy("quality", "reason")
              .agg(F.count(F.lit(1)).alias("rows")))
