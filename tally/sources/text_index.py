"""Trigram filters of the stored table's files, so that text searches skip files.

``write_text_index`` keeps a Bloom filter per file and text column: of each
trigram (``tally.functions.trigrams``) two of ``BITS`` bits are set.  Filters are
stored sparsely, a row per 64-bit word, sorted by column and word, so that a
search reads the few words that its trigrams point at.  Tasks mark the trigrams
of a file's texts in Arrow batches, so that only distinct ones reach the
map-side combined aggregate.

``files_left`` names the files that may hold rows of a ``ReportFilter``.  Files
that the index does not know, such as ones appended later, are always left in,
and the filter itself still runs on the rows: the index changes what is read,
never the result.  A rewritten store loses the index with its folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.trigrams import WIDE_FOLDS, Condition, evaluate, fold, leaves, required

#: Folder inside the store; Spark's readers pass over names with an underscore.
FOLDER = "_text_index"
TEXT_COLUMNS = ("merchant", "description", "notes")
BITS = 1 << 16
SEEDS = (0, 1)
#: ASCII letters in lower case, as whole numbers that trigrams are put together from.
_LOWER = np.array([ord(fold(chr(b))) if b < 128 else b for b in range(256)], np.int32)


def _position(trigram: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(trigram, F.lit(seed)), F.lit(BITS))


def _word(position: Column) -> Column:
    return F.shiftright(position, 6).cast("int")


def _mask(position: Column) -> Column:
    """A word with the bit of ``position``; the shift takes its low six bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(64)).cast("int"))


def _file() -> Column:
    """Month folder and name of a row's file."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def _seen(texts: pa.Array, seen: np.ndarray) -> None:
    """Mark the ASCII trigrams of folded texts (``functions.trigrams``), by their 21 bits."""
    texts = texts.drop_null().cast(pa.large_string())
    if not pc.all(pc.string_is_ascii(texts), min_count=0).as_py():
        for a, b in WIDE_FOLDS:
            texts = pc.replace_substring(texts, a, b)
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if ends[-1] - ends[0] < 3:
        return
    t = _LOWER[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]]
    whole = (t[:-2] | t[1:-1] | t[2:]) < 128
    for back in (1, 2):  # not over the end of a text
        at = ends[1:-1] - ends[0] - back
        whole[at[(at >= 0) & (at < len(whole))]] = False
    seen[((t[:-2] << 14) | (t[1:-1] << 7) | t[2:])[whole]] = True


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct trigrams of each run of rows of one file, by column. A task reads
    its files one after the other, so it keeps the marks of one file."""
    file, seen = None, {}

    def found() -> Iterator[pa.RecordBatch]:
        for name, marks in seen.items():
            at = np.flatnonzero(marks)
            data = np.stack([at >> 14, at >> 7 & 127, at & 127], axis=1).astype(np.uint8).tobytes()
            places = np.arange(0, 3 * len(at) + 1, 3, dtype=np.int32)
            texts = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), len(at)), pa.repeat(pa.scalar(name, pa.string()), len(at)), texts],
                                             ["file", "name", "trigram"])

    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for lo, hi in zip(cuts, cuts[1:]):
            at = files.dictionary[int(codes[lo])].as_py()
            if at != file:
                yield from found()
                file, seen = at, {c: np.zeros(1 << 21, bool) for c in batch.schema.names if c != "file"}
            for c, marks in seen.items():
                _seen(batch.column(c).slice(lo, hi - lo), marks)
    yield from found()


def write_text_index(spark: SparkSession, path: str) -> str:
    """Write the index of a store over all of its files."""
    store = spark.read.parquet(path)
    there = [c for c in TEXT_COLUMNS if c in store.columns]
    rows = store.select(_file().alias("file"), *there).mapInArrow(_trigrams, "file string, name string, trigram string") \
        .select("file", "name", F.explode(F.array(*[_position(F.col("trigram"), s) for s in SEEDS])).alias("at")) \
        .groupBy("file", "name", _word(F.col("at")).alias("word")).agg(F.bit_or(_mask(F.col("at"))).alias("bits"))
    # a row of its own for each file, so that files without texts are known as well
    known = store.select(_file().alias("file")).distinct() \
        .select("file", F.lit("").alias("name"), F.lit(0).alias("word"), F.lit(0).cast("long").alias("bits"))
    out = f"{path.rstrip('/')}/{FOLDER}"
    rows.unionByName(known).repartitionByRange("name", "word").sortWithinPartitions("name", "word").write.mode("overwrite").parquet(out)
    return out


def conditions(flt) -> dict[str, Condition]:
    """What a filter's searches require, by column; columns without any
    requirement are left out, and so are negated searches."""
    searches = {"merchant": "|".join(flt.merchants) if flt.merchants else None,
                "description": flt.description_contains, "notes": flt.notes_contains}
    found = {c: required(p) for c, p in searches.items() if p}
    return {c: need for c, need in found.items() if need != ("all",)}


def skipped(index: DataFrame, needs: dict[str, Condition]) -> DataFrame:
    """``file``: the files in which some column lacks what is required."""
    asked = {(c, t): f"t{i}" for i, (c, t) in enumerate((c, t) for c, need in needs.items() for t in leaves(need))}
    at = {key: [_position(F.lit(key[1]), s) for s in SEEDS] for key in asked}
    read = [(F.col("name") == c) & (F.col("word") == _word(p)) for (c, _), ps in at.items() for p in ps]

    def bit(c: str, p: Column) -> Column:
        hit = (F.col("name") == c) & (F.col("word") == _word(p)) & (F.col("bits").bitwiseAND(_mask(p)) != 0)
        return F.max(F.when(hit, 1).otherwise(0)) == 1

    flags = [reduce(lambda a, b: a & b, [bit(c, p) for p in ps]).alias(asked[c, t]) for (c, t), ps in at.items()]
    files = index.where(reduce(lambda a, b: a | b, read, F.col("name") == "")).groupBy("file").agg(*flags)
    holds = [evaluate(need, lambda t, c=c: F.col(asked[c, t])) for c, need in needs.items()]
    return files.where(~reduce(lambda a, b: a & b, holds)).select("file")


def files_left(spark: SparkSession, path: str, flt) -> list[str] | None:
    """Files of the store that may hold rows of the filter, None for all.  Names
    reach the driver, no more than Spark's own listing of the store holds."""
    store = spark.read.parquet(path)
    needs = {c: need for c, need in conditions(flt).items() if c in store.columns}
    if not needs:
        return None
    base = path.rstrip("/")
    try:
        index = spark.read.parquet(f"{base}/{FOLDER}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    out = {r["file"] for r in skipped(index, needs).toLocalIterator()}
    every = ["/".join(f.split("/")[-2:]) for f in store.inputFiles()]
    return [f"{base}/{f}" for f in every if f not in out] if out else None
