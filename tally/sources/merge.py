"""Repeated downloads into the stored table.

Downloads overlap: a window of days is fetched again and again, each time with
the rows that came since. ``merge_store`` adds to the store what a download
holds beyond it. Equal rows are counted, not numbered one by one: a row that a
download holds d times and the store s times is appended max(d - s, 0) times, so
true repeats (two equal purchases on a day) stay, and a second load of the same
window appends nothing.

Nothing is rewritten: only months with new rows get files, beside the ones they
have, and rows that the store has and the download lacks stay. An append that
was interrupted is completed by running the merge again, since what arrived is
counted as there. One merge into a store at a time.

Counting is one map-side combined aggregate over the download and the store's
months of the download's span, so a row that repeats very often is one partial
row per task. Its missing copies are spread in blocks before they are written.

Rows are compared on all columns of the store but its helper columns, null equal
to null. A column that the download lacks is null there; one that the store lacks
is refused, because its values would be lost. Rows without a date are compared
with those of the store's null month. An empty download changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators.filters import MONTH
from tally.sources.store import read_store, row_columns, write_store

#: Copies of one row that one task writes at most before others take part.
COPIES = 4096


def _months(df: DataFrame):
    """Lowest and highest month of the dated rows, and whether some lack a date: one row."""
    m = F.date_format("date", "yyyy-MM")
    return df.agg(F.min(m).alias("lo"), F.max(m).alias("hi"),
                  F.coalesce(F.bool_or(F.col("date").isNull()), F.lit(False)).alias("undated")).first()


def _aligned(df: DataFrame, store: DataFrame) -> DataFrame:
    """The download in the columns and types of the store's rows."""
    columns = row_columns(store)
    unknown = sorted(set(df.columns) - set(columns))
    if unknown:
        raise ValueError(f"the store has no column {', '.join(unknown)}")
    types = {f.name: f.dataType for f in store.schema.fields}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns])


def _missing_blocks(store: DataFrame, download: DataFrame) -> DataFrame:
    """Rows of ``download`` beyond those of ``store``: a row for each block of up to
    ``COPIES`` missing copies, with the number of copies from ``_from`` on."""
    columns = row_columns(store)
    found = _aligned(download, store)
    span = _months(found)
    dated = F.col(MONTH).between(F.lit(span["lo"]), F.lit(span["hi"])) if span["lo"] else F.lit(False)
    there = store.where(dated | F.col(MONTH).isNull() if span["undated"] else dated).select(*columns)
    counts = found.withColumn("_copies", F.lit(1)).unionByName(there.withColumn("_copies", F.lit(-1))) \
        .groupBy(*columns).agg(F.sum("_copies").alias("_copies")).where("_copies > 0")
    return counts.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(COPIES))))


def _copies(blocks: DataFrame) -> DataFrame:
    """A row for each copy of a block."""
    number = F.least(F.lit(COPIES), F.col("_copies") - F.col("_from"))
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1), number))).drop("_copy", "_copies", "_from")


def missing_rows(store: DataFrame, download: DataFrame) -> DataFrame:
    """Rows of ``download`` beyond those of ``store``, a row for each copy that is missing."""
    return _copies(_missing_blocks(store, download).hint("rebalance"))


def merge_store(spark: SparkSession, path: str, download: DataFrame) -> str:
    """Append to the store what ``download`` holds beyond it. The download is read
    twice; write it down first where that is expensive."""
    store = read_store(spark, path)
    # one shuffle: it carries blocks, dealt by month and block, and they become copies behind it
    write_store(_missing_blocks(store, download), path, mode="append", spread=("_from",), behind=_copies)
    return path
