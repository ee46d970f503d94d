"""Exact quantiles of a money column without a single-task value map.

``percentile`` keeps a value→count map per partial aggregate and merges all
of them in one final task. Here the input is read once, by one map-side
combined aggregate to (value, rows); everything else works on that table:

1. Histogram: every value, as an exact integer in units of the column's
   scale, goes to a bucket of its bit length, split into at most
   ``2 ** BUCKET_BITS`` equal ranges. A bucket's members form one integer
   interval, so buckets sorted by their smallest member are in value order.
2. Descent: a cumulative window over the bucket rows (bounded count) finds,
   for each target rank, the bucket holding it. Each round splits the buckets
   that are left (at most two per quantile, a proven bound for the broadcast)
   by their next ``ROUND_BITS`` bits, in one combined aggregate, until a
   bucket is a single value. So a task orders at most ``2 ** ROUND_BITS``
   rows of a bucket in any round, however many values the bucket has. The
   number of rounds follows from the column's type: 3 for DECIMAL(18).

All rounds read the same aggregate, whose exchange Spark runs once. Nothing
runs before an action.

Interpolation follows linear interpolation between the values at ranks
floor and ceil of (n−1)·p: (hi_rank − pos)·lo + (pos − lo_rank)·hi.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.functions.money import to_double
from tally.operators.stats import stddev_samp

BUCKET_BITS = 12
ROUND_BITS = 16


def units(c: Column, scale: int) -> Column:
    """DECIMAL(18, scale) → exact integer in units of the last decimal."""
    factor = F.lit(10 ** scale).cast(T.DecimalType(scale + 1, 0))
    return (c * factor).cast("long")


def value(u: Column, scale: int) -> Column:
    """The way back from ``units``."""
    return (u.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale)).cast(T.DecimalType(scale + 1, scale))).cast(T.DecimalType(19 + scale, scale))


def shift(u: Column) -> Column:
    """Low bits of ``u`` that its bucket leaves open, by the bit length of |u|."""
    return F.greatest(F.length(F.bin(F.abs(u))) - F.lit(BUCKET_BITS + 1), F.lit(0))


def prefix(u: Column, k: Column, done: int) -> Column:
    """``u`` shifted right (rounding down) by what ``done`` rounds leave of the
    shift ``k``; the whole of ``u`` once nothing is left."""
    return F.call_function("shiftright", u, F.greatest(k - F.lit(ROUND_BITS * done), F.lit(0)))


def rounds(precision: int) -> int:
    """Rounds after the histogram until the longest shift of a column is used up."""
    longest = min((10 ** precision - 1).bit_length(), 63)
    return max(-(-(longest - BUCKET_BITS - 1) // ROUND_BITS), 0)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """One row per distinct value: ``v``, ``rows``, its integer ``u`` and the shift
    ``k`` of its bucket (both null for the null value)."""
    v = F.col(col)
    if not isinstance(df.schema[col].dataType, T.DecimalType):
        v = v.cast(T.DecimalType(18, 2))
    counts = df.select(v.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("rows"))
    u = units(F.col("v"), counts.schema["v"].dataType.scale)
    return counts.select("v", "rows", u.alias("u"), shift(u).alias("k"))


def _holds(ranks: Sequence[Column]) -> list[Column]:
    """Whether a bucket holds each rank."""
    return [(F.col("before") <= r) & (r < F.col("before") + F.col("n")) for r in ranks]


def descend(vals: DataFrame, need: DataFrame, done: int, ranks: Sequence[Column]) -> DataFrame:
    """The buckets of ``need`` (k, q, before, total) split by their next bits; the
    parts that hold a rank."""
    a = vals.withColumn("q", prefix(F.col("u"), F.col("k"), done - 1)).alias("a")
    b = F.broadcast(need.drop("n").alias("b"))  # at most two buckets per quantile
    # null-safe, as plain equality would filter nulls below the shared exchange and so split it
    inside = a.join(b, F.col("a.k").eqNullSafe(F.col("b.k")) & F.col("a.q").eqNullSafe(F.col("b.q"))) \
        .select("b.*", "a.u", "a.rows")
    bucket = ["k", "q", "before", "total"]
    parts = inside.groupBy(*bucket, prefix(F.col("u"), F.col("k"), done).alias("part")).agg(F.sum("rows").alias("n"))
    running = Window.partitionBy("k", "q").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.select("k", F.col("part").alias("q"), "total", "n",
                        (F.col("before") + F.sum("n").over(running) - F.col("n")).alias("before")) \
        .where(F.greatest(*_holds(ranks), F.lit(False)))


def quantile_summary(df: DataFrame, col: str, probs: Sequence[float],
                     names: Sequence[str]) -> DataFrame:
    """One row: exact quantiles of ``col`` plus its moments.

    Columns: the quantile ``names`` and ``rows`` (all rows), ``n`` (values),
    ``s`` (exact sum, 0 when none), ``mn``, ``mx``, ``sd`` (sample std).
    """
    vals = value_counts(df, col)
    scale = vals.schema["v"].dataType.scale
    v, m = F.col("v"), F.col("rows")
    zero = F.lit(0).cast(T.DecimalType(38, scale))
    # squares keep all their decimals: up to 6 of them in a DECIMAL product, beyond that as integers
    fine = scale > 3
    x = units(v, scale).cast("decimal(19,0)") if fine else v
    square = x * x if fine else (x * x).cast(T.DecimalType(38, 2 * scale))
    hist = vals.groupBy("k", prefix(F.col("u"), F.col("k"), 0).alias("q")).agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), m)), F.lit(0)).alias("n"), F.min("u").alias("lo"),
        F.sum(m).alias("rows"), F.coalesce(F.sum(v * m.cast("decimal(18,0)")), zero).alias("s"),
        F.min(v).alias("mn"), F.max(v).alias("mx"),
        F.sum(square * m.cast("decimal(18,0)")).alias("sq"))
    # bounded: at most 2^BUCKET_BITS buckets per bit length and sign, plus the null bucket (n = 0)
    running = Window.orderBy(F.col("lo").asc_nulls_first(), "k", "q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.select("k", "q", "n", (F.sum("n").over(running) - F.col("n")).alias("before"),
                      F.sum("n").over(Window.partitionBy()).alias("total"))
    pos = [(F.col("total") - 1).cast("double") * F.lit(float(p)) for p in probs]
    ranks = [r for p in pos for r in (F.floor(p), F.ceil(p))]
    need = cum.where(F.greatest(*_holds(ranks), F.lit(False)))
    for done in range(1, rounds(vals.schema["v"].dataType.precision) + 1):
        need = descend(vals, need, done, ranks)

    # the picked values beside the moments, which come from the histogram's rows
    picked = need.agg(*[F.max(F.when(held, F.col("q"))).alias(f"u{i}") for i, held in enumerate(_holds(ranks))])
    moments = hist.agg(F.sum("n").alias("total"), F.sum("rows").alias("rows"), F.sum("s").alias("s"),
                       F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("sq").alias("sq"))
    both = moments.unionByName(picked, allowMissingColumns=True)
    agg = both.agg(*[F.max(c).alias(c) for c in both.columns])
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        position = (F.col("total") - 1).cast("double") * F.lit(float(p))
        lo_r, hi_r = F.floor(position), F.ceil(position)
        lo, hi = to_double(value(F.col(f"u{2 * i}"), scale)), to_double(value(F.col(f"u{2 * i + 1}"), scale))
        val = F.when((lo_r == hi_r) | (lo == hi), lo) \
               .otherwise((hi_r - position) * lo + (position - lo_r) * hi)
        out.append(val.alias(name))
    total_x = (F.col("s") * F.lit(10 ** scale).cast(T.DecimalType(scale + 1, 0))).cast("decimal(38,0)") if fine else F.col("s")
    sd = stddev_samp(total_x, F.col("total"), F.col("sq")) / F.lit(float(10 ** scale) if fine else 1.0)
    # an empty input has no bucket rows: the global aggregate still yields one row
    return agg.select(*out, F.coalesce(F.col("rows"), F.lit(0)).alias("rows"),
                      F.coalesce(F.col("total"), F.lit(0)).alias("n"),
                      F.coalesce(F.col("s"), zero).alias("s"), "mn", "mx", sd.alias("sd"))
