"""Size-checked broadcast of join sides.

A side is broadcast only with a measured bound on its size:
1. rows: ``count()`` of each input (a footer-only parquet scan, cheap at
   any scale). If any input exceeds ``MAX_BROADCAST_ROWS`` the side is left
   to the planner (sort-merge join, with AQE free to switch at runtime), and
   nothing else is read.
2. bytes: for bounded inputs, one aggregate over the side itself sums the
   real string bytes plus a fixed per-field cost (UnsafeRow layout). Only
   under ``max_bytes`` does the side get the broadcast hint.
Results are memoized per side key, so each dimension is measured once per
application; ``reset_decisions()`` forgets them when files change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.session import app_key

MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_MAX_BYTES = 64 * 1024 * 1024
CONF_MAX_BYTES = "tally.broadcast.maxBytes"

_DECISIONS: dict = {}


def _max_bytes(df: DataFrame) -> int:
    v = df.sparkSession.conf.get(CONF_MAX_BYTES, None)
    return int(v) if v else DEFAULT_MAX_BYTES


def measured_bytes(df: DataFrame) -> int:
    """Upper bound of the side's in-memory row size: 8 bytes per field and
    per row header plus the actual bytes of every string/binary value."""
    var = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in df.schema.fields
           if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    per_row = 8 * (len(df.columns) + 1)
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 (F.sum(sum(var[1:], var[0])) if var else F.lit(0)).alias("v")).first()
    return int(row.n) * per_row + int(row.v or 0)


def prepare_broadcasts(items: list[tuple[str, DataFrame, list[DataFrame] | None]],
                       max_bytes: int | None = None) -> None:
    """Decide several sides at once in two jobs instead of two per side:
    one job counts the rows of every input (a union of footer-only scans),
    one job measures the bytes of the sides whose inputs passed."""
    todo = [(k, side, inputs or [side]) for k, side, inputs in items
            if (app_key(side.sparkSession), k) not in _DECISIONS]
    if not todo:
        return
    frames = []
    for _, _, inputs in todo:
        for i in inputs:
            if all(i is not f for f in frames):
                frames.append(i)
    tagged = [f.select(F.lit(n).alias("i")) for n, f in enumerate(frames)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionAll(t)
    counts = {r.i: r["count"] for r in union.groupBy("i").count().collect()}
    rows_of = lambda f: counts.get(next(n for n, g in enumerate(frames) if g is f), 0)
    passing = [(k, side) for k, side, inputs in todo
               if all(rows_of(i) <= MAX_BROADCAST_ROWS for i in inputs)]
    sizes = {}
    if passing:
        parts = [_measure_row(side, k) for k, side in passing]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionAll(p)
        sizes = {r.k: int(r.n) * 8 * (len(dict(passing)[r.k].columns) + 1) + int(r.v or 0)
                 for r in union.collect()}
    for k, side, _ in todo:
        limit = max_bytes or _max_bytes(side)
        _DECISIONS[(app_key(side.sparkSession), k)] = k in sizes and sizes[k] <= limit


def _measure_row(side: DataFrame, key: str) -> DataFrame:
    var = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in side.schema.fields
           if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return side.agg(F.lit(key).alias("k"), F.count(F.lit(1)).alias("n"),
                    (F.sum(sum(var[1:], var[0])) if var else F.lit(0)).cast("long").alias("v"))


def sized_broadcast(side: DataFrame, key: str, inputs: list[DataFrame] | None = None,
                    max_bytes: int | None = None) -> DataFrame:
    """``broadcast(side)`` if its measured size is under the bound, else ``side``."""
    k = (app_key(side.sparkSession), key)
    if k not in _DECISIONS:
        limit = max_bytes or _max_bytes(side)
        ok = all(i.count() <= MAX_BROADCAST_ROWS for i in (inputs or [side]))
        _DECISIONS[k] = ok and measured_bytes(side) <= limit
    if not _DECISIONS[k]:
        return side
    return F.broadcast(side)


def reset_decisions() -> None:
    _DECISIONS.clear()
