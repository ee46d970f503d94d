"""The normalized transaction table stored for repeated reporting.

Reports over a raw source redo coercion (and, for the fixtures, the joins)
on every run. ``write_store`` materializes the normalized table once as
parquet partitioned by ``txn_month`` ('yyyy-MM'); ``ReportFilter`` adds a
``txn_month`` bound next to its date bounds when the column exists, so date
filters prune whole partitions, and the date comparison itself is pushed
into the parquet scan of the remaining ones. Lower-cased category and account
are stored as well, and files are sorted by them, so membership filters reach
the scan and skip row groups. ``row_columns`` hides these helper columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators.filters import ACCOUNT_LC, CATEGORY_LC, MONTH as PARTITION_COLUMN, STORE_COLUMNS, ReportFilter
from tally.sources.text_index import files_left


def write_store(df: DataFrame, path: str, mode: str = "errorifexists", spread: tuple[str, ...] = (),
                behind: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> str:
    """Write partitioned by month; rows without a date go to the null partition.

    The REBALANCE shuffle on ``txn_month`` makes each task write few
    partition folders (no small-file explosion), and AQE splits a month that
    holds a large share of the rows into several tasks and files
    (``spark.sql.adaptive.optimizeSkewsInRebalancePartitions``). What can be made
    from a row is made behind the shuffle, so that it does not travel: the helper
    columns, and what ``behind`` does. ``spread`` names columns of ``df`` that deal
    the rows of a month over several tasks.
    """
    m = F.date_format("date", "yyyy-MM")
    rows = behind(df.withColumn(PARTITION_COLUMN, m).hint("rebalance", PARTITION_COLUMN, *spread))
    extra = {}
    for name, source in ((CATEGORY_LC, "category"), (ACCOUNT_LC, "account")):
        if source in df.columns:
            extra[name] = F.lower(source)
    (rows.withColumns(extra).sortWithinPartitions(PARTITION_COLUMN, *extra)
       .write.mode(mode).partitionBy(PARTITION_COLUMN).parquet(path))
    return path


def row_columns(df: DataFrame) -> list[str]:
    """The columns of a table without those that only the store adds."""
    return [c for c in df.columns if c not in STORE_COLUMNS]


def read_store(spark: SparkSession, path: str, flt: ReportFilter | None = None) -> DataFrame:
    """The stored table. With a filter, files that its text searches cannot match
    are not read where the store has a text index (``sources.text_index``); the
    filter itself is still to be applied."""
    store = spark.read.parquet(path)
    files = files_left(spark, path, flt) if flt else None
    if files is None:
        return store
    if not files:
        return store.where(F.lit(False))
    return spark.read.schema(store.schema).option("basePath", path).parquet(*files)
