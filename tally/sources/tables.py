"""Readers for the driver's parquet tables.

Each reader selects only the columns the fixtures use, so the parquet
scan's ReadSchema stays narrow and filters on them can be pushed down.
Table handles are kept per session and path: re-reading a parquet path
repeats file listing and footer reads on the driver (~0.1 s per table),
which dominated small queries. ``refresh_tables()`` drops the handles
after files change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.session import app_key

_HANDLES: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), app_key(spark), path)
    df = _HANDLES.get(key)
    if df is None:
        df = _HANDLES[key] = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def refresh_tables() -> None:
    """Forget table handles, the fixture plans built on them, and what was
    measured and cached of join sides."""
    from tally.operators.joins import reset_decisions
    from tally.sources.fixtures import clear_plans
    _HANDLES.clear()
    clear_plans()
    reset_decisions()
