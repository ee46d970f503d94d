"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingle hashes have
it.  Fingerprints that differ in at most two bits are linked.  Their 64 bits are
cut into two segments of 32.  Of two linked fingerprints, either the second
segments are equal, or the first ones differ in at most one bit.  So the table
of first segments is searched for a ball of radius 1 around each first segment
(of the pair that differ in a bit, the one that has it looks up the other), the
table of second segments for the segment itself, and complete distances decide.

All this runs on distinct fingerprints, so copies never meet in pairs.  A table
entry with more than ``BUCKET`` fingerprints is searched further instead of
pair by pair: its members differ in the other segment only, and two values are
within two bits exactly if their balls of radius 1 share a value.  Each member
emits its ball, each shared value links its few members (33 at most) to the
smallest one, and no link between components is lost.

Defined results: null and empty texts have no words and fingerprint zero, which
links like any other; fewer words than a shingle make one shingle; repeated rows
give repeated rows; a null id counts as no id when the smallest id of a
component is taken; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import pick, plain_columns, same, text_slices
from tally.llm.components import connected
from tally.session import ensure_checkpoint_dir

SEED = 42
#: Fingerprints that a table entry may hold to be searched pair by pair.
BUCKET = 32
LOW = 0xFFFFFFFF


def fingerprint(text: bytes, shingle: int) -> int:
    """Unsigned 64-bit SimHash of a text."""
    import xxhash

    # bytes.lower changes A-Z alone, bytes.split cuts at [\x20\x09-\x0D]+
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.append(0, end[:-1] + 1)
    last = min(shingle, len(words)) - 1
    cuts = map(slice, start[:len(words) - last].tolist(), end[last:].tolist())
    n = len(words) - last
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = hashes[lo:lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint as a signed 64-bit value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()
                fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"),
                                                  pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    src = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _flips(value: Column, bits: range) -> Column:
    """The value and all values that differ from it in one of the bits."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in bits])


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``u, v`` that connect all distinct fingerprints ``fp`` within
    ``max_bits`` (up to 2) of each other, each within that distance itself."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    first, second = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    table = fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), first.alias("value")),
        F.struct(F.lit(1).alias("seg"), second.alias("value")))).alias("e")).select("fp", "e.seg", "e.value")
    counts = table.groupBy("seg", "value").count()
    full = counts.where(F.col("count") > BUCKET).select("seg", "value", F.lit(True).alias("full"))
    entries = table.join(full, ["seg", "value"], "left").withColumn("full", F.coalesce("full", F.lit(False))).checkpoint()

    # within one table entry
    small = entries.where("not full")
    pairs = small.select("seg", "value", F.col("fp").alias("u")) \
        .join(small.select("seg", "value", F.col("fp").alias("v")), ["seg", "value"]).where("u > v").select("u", "v")
    # fullness is of the entry, so a fingerprint may be in one full entry and in one small one
    mids = entries.where("full").select("fp", F.explode(
        F.when(F.col("seg") == 0, _flips(F.col("fp"), range(32))).otherwise(_flips(F.col("fp"), range(32, 64)))).alias("mid"))
    if max_bits == 2:
        heads = mids.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("mid", "v")
    else:  # a ball of radius 1 holds the linked values themselves
        heads = fps.select(F.col("fp").alias("mid"), F.col("fp").alias("v"))
    inside = mids.join(heads, "mid").where("fp != v").select(F.col("fp").alias("u"), "v")

    # first segments that differ in one bit: who has the bit asks for the value without it
    ask = fps.select(F.col("fp").alias("u"), F.explode(F.array_compact(F.array(*[
        F.when(first.bitwiseAND(F.lit(1 << b)) != 0, first.bitwiseXOR(F.lit(1 << b))) for b in range(32)]))).alias("value"))
    heads0 = entries.where("seg = 0")
    near = ask.join(heads0.where("not full").select("value", F.col("fp").alias("v")), "value").select("u", "v")
    asked = ask.join(full.where("seg = 0").select("value"), "value") \
        .select("u", F.explode(_flips(F.shiftleft("value", 32).bitwiseOR(F.col("u").bitwiseAND(F.lit(LOW))), range(32))).alias("v"))
    near_full = asked.join(heads0.where("full").select(F.col("fp").alias("v")), "v").select("u", "v")
    return pairs.unionByName(inside).unionByName(near).unionByName(near_full).where(_distance("u", "v") <= max_bits)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, text_hash, is_first``.

    ``component_id`` is the smallest id that links reach from the document;
    ``is_first`` marks the rows of one text of the component that has that id
    (of several such texts, the one with the smallest ``text_hash``)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    found = fingerprints(docs, shingle, id_col, text_col).checkpoint()
    no_id = F.col("doc_id").isNull()
    distinct = found.groupBy("fp").agg(F.min(F.struct(no_id.alias("no_id"), "doc_id", "text_hash")).alias("first")).checkpoint()
    roots = connected(links(distinct.select("fp"), max_bits))
    member = distinct.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first").alias("least"))
    component = member.select("fp", "root").join(smallest, "root").select("fp", "least")
    return found.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"),
        "text_hash", (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("text_hash").eqNullSafe(F.col("least.text_hash"))).alias("is_first"))


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each component, with all their columns.
    Copies of a row go before they are sent anywhere; a text moves once at most."""
    marks = near_duplicates(docs, shingle, max_bits, id_col, text_col).where("is_first") \
        .select(same(F.col("doc_id")).alias("_id"), F.col("text_hash").alias("_h")).distinct()
    names = docs.columns
    cols = [f"_c{i}" for i in range(len(names))]
    flat = docs.toDF(*cols)
    key, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    order = [c for c in plain_columns(flat) if c != text] or [key]
    copy = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(*order))
    first = flat.withColumns({"_id": same(F.col(key)), "_h": F.xxhash64(text)}).withColumn("_copy", copy).where("_copy = 1")
    return first.join(marks, ["_id", "_h"]).select(*cols).toDF(*names)
