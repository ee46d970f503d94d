"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame
operations only.

Sources have targets in words (``targets``).  The words of a source, its
documents in shuffled order, form a stream that is cut into blocks of ``BLOCK``
words.  The mix is a schedule of slots, one block each: slot ``i`` takes the
point ``frac(i * golden ratio)`` and the source whose interval of cumulative
target shares holds it, so every stretch of the schedule has the target shares
closely.  A source's slots are ranked; rank ``r`` is block ``r`` of its stream,
which starts anew when it ends.  Ranks beyond the target are dropped, ranks that
the points left out close the schedule, and the last block of a source is cut at
its target, so that the words taken equal the target to within one word and no
document is taken more than ``MAX_TIMES`` times.

Slots are ranked in two steps (per range of slots, then the ranges' counts), and
streams are summed the same way (per range of the shuffle key), so no source is
gathered in one task.  Only tables with a row per source are sorted as a whole.

Defined results: null text has size 0; documents of size 0 are taken 0 words;
null sources form one source, last; repeated rows are separate rows with the
same shuffle key; null ids count as empty text in it; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import pick, plain_columns, same, word_count
from tally.session import ensure_checkpoint_dir

BLOCK = 256
MAX_TIMES = 3
WEIGHTS = (1, 2, 3)
GOLDEN = (5 ** 0.5 - 1) / 2
#: Cells of equal width into which the unit interval is cut to look up points.
CELLS = 4096
#: Rows up to which a table with a row per source is broadcast.
BROADCAST_ROWS = 100_000
#: Slots that are ranked together, and rows that one range of shuffle keys should hold.
SLOTS_PER_RANGE = 1 << 16
ROWS_PER_RANGE = 1 << 14


def _per_source(table: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= bound else table


def targets(sizes: DataFrame) -> DataFrame:
    """``place, source, source_size, weight, target`` of ``source, source_size``.

    Sources in code-point order, null last, weigh ``WEIGHTS`` in turn and share
    the sum of all sizes; none gets more than ``MAX_TIMES`` its size, and what
    is cut off is shared anew by weight.  With sources sorted by size per
    weight, the first ones are cut: as many as have a share per weight, of what
    those before them leave over, at or above their own limit."""
    everything = Window.partitionBy(F.lit(0))
    n = len(WEIGHTS)
    placed = sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1)
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % n + 1).cast("int")))
    limit = F.lit(MAX_TIMES) * F.col("source_size")
    order = everything.orderBy(limit / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest_words = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    cut = weighed.withColumns({"limit": limit, "share": rest_words / rest_weight}) \
        .withColumn("is_cut", F.col("share") * F.col("weight") >= F.col("limit"))
    # once a source in this order is not cut, none after it is
    level = F.min(F.when(~F.col("is_cut"), F.struct(F.col("limit") / F.col("weight"), "place", "share"))).over(everything)["share"]
    return cut.select("place", "source", "source_size", "weight", F.when(
        F.col("is_cut"), F.col("limit")).otherwise(F.col("weight") * level).cast("double").alias("target"))


def _blocks(words: Column) -> Column:
    return F.ceil(words / BLOCK).cast("long")


def plan(sizes: DataFrame) -> DataFrame:
    """Targets with whole ``words`` to take, the stream's ``n_blocks``, the
    ``slots`` to fill and the share interval ``lo`` to ``hi`` of the points."""
    everything = Window.partitionBy(F.lit(0))
    goal = targets(sizes).withColumn("words", F.least(F.round("target").cast("long"), MAX_TIMES * F.col("source_size")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    out = goal.withColumns({"n_blocks": _blocks(F.col("source_size")), "full": full}) \
        .withColumn("slots", F.col("full") * F.col("n_blocks") + _blocks(F.col("words") - F.col("full") * F.col("source_size")))
    order = everything.orderBy("place")
    upto = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.greatest(F.sum("slots").over(everything), F.lit(1))
    return out.withColumns({"lo": (upto - F.col("slots")) / total, "hi": upto / total}).drop("full")


def points(slot: Column) -> Column:
    """``frac(slot * GOLDEN)``, from the slot's high and low 20 bits apart so
    that large numbers keep their fractions."""
    high = F.shiftright(slot, 20) * F.lit((GOLDEN * (1 << 20)) % 1.0)
    x = high - F.floor(high) + slot.bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(GOLDEN)
    return x - F.floor(x)


def schedule(goal: DataFrame) -> DataFrame:
    """``slot, place, rank, epoch, block`` of the slots of a plan, in the order
    of the mix: the points' slots, then those that close it."""
    spark = goal.sparkSession
    total = goal.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    drawn = spark.range(total).withColumn("point", points(F.col("id"))).withColumn("cell", F.floor(F.col("point") * CELLS))
    # each source is listed under the cells that its interval touches
    cells = goal.where("slots > 0").select("place", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    held = drawn.join(_per_source(cells), "cell").where("point >= lo and point < hi")
    ranges = held.select(F.col("id").alias("slot"), "place", F.floor(F.col("id") / SLOTS_PER_RANGE).alias("range"))
    counts = ranges.groupBy("place", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("place", "range", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("place", "range").orderBy("slot")) - 1
    ranked = ranges.withColumn("inside", inside).join(offsets, ["place", "range"]) \
        .select("slot", "place", (F.col("inside") + F.col("offset")).alias("rank"))
    # ranks that the points did not reach
    drawn_counts = counts.groupBy(F.col("place").alias("_place")).agg(F.sum("n").alias("drawn"))
    left = goal.join(drawn_counts, F.col("place") == F.col("_place"), "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))) \
        .where("drawn < slots").select("place", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("rank"))
    closing = left.select((F.lit(total) + F.col("rank")).alias("slot"), "place", "rank")
    used = ranked.unionByName(closing).join(_per_source(goal.select("place", "slots", "n_blocks")), "place").where("rank < slots")
    return used.select("slot", "place", "rank", F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"),
                       (F.col("rank") % F.col("n_blocks")).alias("block"))


def streams(docs: DataFrame, goal: DataFrame, rows: int) -> DataFrame:
    """Documents with their places in the shuffled streams: ``start`` is the
    number of words before a document, ``range, nth`` name its row.  The order
    is that of the MD5 of id and text; its high bits split a source into ranges."""
    bits = min(32, max(4, (rows // ROWS_PER_RANGE).bit_length()))
    head = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    keyed = docs.join(_per_source(goal.select("place", F.col("source").alias("_source"))), F.col("source").eqNullSafe(F.col("_source"))) \
        .drop("_source").withColumn("range", F.shiftright(head, 32 - bits))
    sums = keyed.groupBy("place", "range").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("place", "range", F.coalesce(before, F.lit(0)).alias("offset"))
    order = Window.partitionBy("place", "range").orderBy("shuffle", "doc_id", "size")
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.withColumns({"inside": inside, "nth": F.row_number().over(order)}).join(offsets, ["place", "range"]) \
        .withColumn("start", F.col("inside") + F.col("offset")).drop("inside", "offset")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, text_hash, shuffle``."""
    src = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    return src.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
                      F.md5(F.concat(
                          F.lit("mix|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"),
                          F.md5(F.coalesce("text", F.lit(""))))).alias("shuffle"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, text_hash``: the words
    that the mix takes of each document, counted once for each time."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = sized(docs, id_col, text_col, source_col).checkpoint()
    goal = plan(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).checkpoint()
    placed = streams(rows, goal, rows.count()).drop("source")
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    parts = placed.withColumn("block", F.explode_outer(F.when(
        F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), last))))
    slots = schedule(goal).select("place", "epoch", "block")
    per_source = _per_source(goal.select("place", "source", "source_size", "target", "words"))
    held = parts.join(slots, ["place", "block"], "left").join(per_source, "place")
    # the stream of an epoch ends at the target's last word
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK, F.col("words") - F.col("epoch") * F.col("source_size"))
    here = F.greatest(end - F.greatest("start", F.col("block") * BLOCK), F.lit(0))
    taken = F.coalesce(F.sum(F.when(F.col("epoch").isNotNull(), here)), F.lit(0)).cast("long")
    whole = held.groupBy("place", "range", "nth", "doc_id", "size", "text_hash").agg(taken.alias("taken"))
    return whole.join(per_source, "place").select("doc_id", "size", "source_size", "target", "taken", "source", "text_hash")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of ``docs``: each document as many times as the mix takes
    it, its words taken over its size, rounded (only documents at the ends of
    streams are taken in part).  Rows of one id, source and text count as one
    document that is taken the sum of their times; the first of them stands for
    it."""
    times = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    takes = mix(docs, id_col, text_col, source_col).groupBy(
        same(F.col("doc_id")).alias("_id"), same(F.col("source")).alias("_source"), F.col("text_hash").alias("_h")) \
        .agg(F.sum(times).alias("_times")).where("_times > 0")
    names = docs.columns
    cols = [f"_c{i}" for i in range(len(names))]
    flat = docs.toDF(*cols)
    id_, text, source = (f"_c{names.index(c)}" for c in (id_col, text_col, source_col))
    order = [c for c in plain_columns(flat) if c not in (id_, text, source)] or [id_]
    # joined by the keys of the window, so that a text moves once
    keys = {"_id": same(F.col(id_)), "_source": same(F.col(source)), "_h": F.xxhash64(text)}
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = flat.withColumns(keys).withColumn("_n", copy).where("_n = 1")
    out = first.join(takes, list(keys)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*cols).toDF(*names)
