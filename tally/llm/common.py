"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType,
                               TimestampType)

from tally.session import scratch_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Select ``new=old`` columns by exact name.

    Columns are addressed by position, so names that differ only in case, or
    repeated names (the first one counts), do not make a reference ambiguous.
    All other columns are dropped.
    """
    names = df.columns
    missing = [c for c in cols.values() if c not in names]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_c{names.index(old)}").alias(new) for new, old in cols.items()])


def plain_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be sorted."""
    plain = (StringType, NumericType, BooleanType, DateType, TimestampType, TimestampNTZType, BinaryType)
    return [f.name for f in df.schema if isinstance(f.dataType, plain)]


def same(value: Column) -> Column:
    """Text that is equal for two values of a column if they are, or if both are
    null.  A join on it leaves rows dealt as a window over it needs them."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared scratch folder and read back,
    so that later reads take only the columns they need.  Columns must be of
    types that Parquet holds."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A plain reference may be inlined by the optimizer into the lambdas of a
    higher-order function and would then run once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    flat = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(flat, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def text_slices(batch: pa.RecordBatch, name: str, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``budget`` bytes of text each.

    A row is never cut, so one long text makes a slice of its own.
    """
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size, dtype=np.int64) - size) // budget
    cut = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def utf8_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the offset of each row."""
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """String column over the bytes between consecutive offsets."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
