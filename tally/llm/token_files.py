"""Token-id files: documents as Simple-8b coded ids, in ascending ``doc_id``.

``write_tokens`` deals whole documents to shards by range of ``doc_id``, encodes
them with a tokenizers-library file and writes Parquet rows of about a million
ids: the documents' ids and lengths, the words, and the word offset of every
``simple8b.BLOCK`` ids.  ``read_tokens`` reads such a folder back; a task holds
one row at a time.  The folder must be one that all executors share.

Defined results: null text counts as empty, so it has the end id alone; null ids
come first; rows with equal ids stay separate, ordered by a hash of their text;
other columns are ignored; an empty table gives a folder without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.llm import simple8b
from tally.llm.common import pick, text_slices, utf8_buffer
from tally.llm.segments import Coded, Memo, Tokens, byte_level, strung

ROW_IDS = 1 << 20
#: Bytes of text that are encoded at a time (one document at least).
SLICE = 12 << 20
SCHEMA = ("shard int, part int, shard_start long, n_ids long, doc_ids array<{kind}>, doc_lens array<long>, "
          "block_offsets binary, words binary")


class ByteEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, threads: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.sizes = self._sizes()
        self.memo = Memo(self._encode)

    def _sizes(self) -> np.ndarray:
        """Bytes that each id stands for: one character of a byte-level piece
        is one byte, an added token is its own text."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = self.tokenizer.get_added_tokens_decoder()
        out = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)
        for piece, i in vocab.items():
            out[i] = len(piece)
        for i, token in added.items():
            out[i] = len(token.content.encode())
        return out

    def _ids(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0, np.uint32)]
        for i in range(0, len(texts), 128):  # the library's results are many times larger than the ids
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i:i + 128], add_special_tokens=False)]
        return np.concatenate(out)

    def _encode(self, segments: pa.Array) -> Coded:
        """Segments that begin with a space and end in visible ASCII go to the
        library strung together (no token crosses such ends), and come apart by
        the bytes that ids stand for; the others go one by one."""
        data, off = utf8_buffer(segments)
        apart = (data[off[:-1]] != 0x20) | (data[off[1:] - 1] <= 0x20) | (data[off[1:] - 1] >= 0x7F)
        order, alone, groups, _ = strung(segments, apart, 256)
        flat = self._ids(alone + groups)
        end = np.cumsum(np.diff(off)[order])
        reach = np.append(0, np.cumsum(self.sizes[flat]))
        last = np.searchsorted(reach, end)
        if not np.array_equal(reach[np.minimum(last, len(flat))], end):
            raise ValueError("ids of the vocabulary file do not end where segments end")
        out = Coded(flat, np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros((len(order), 0), bool))
        out.first[order], out.size[order] = np.append(0, last)[:-1], np.diff(last, prepend=0)
        return out

    def __call__(self, text: pa.Array) -> Tokens:
        """Each distinct segment is encoded once, and again only after the
        worker's memo started anew."""
        return self.memo(byte_level(text))[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def _with_end(tokens: Tokens, end_id: int) -> Tokens:
    rows = len(tokens.bounds) - 1
    return Tokens(np.insert(tokens.ids, tokens.bounds[1:], np.uint32(end_id)), tokens.bounds + np.arange(rows + 1))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the folder ``path``; it must not exist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        part = start = 0
        for batch in batches:
            for piece in text_slices(batch, "text", SLICE):
                tokens = _with_end(encode(pc.fill_null(piece.column("text"), "")), end_id)
                cut = np.flatnonzero(np.diff(tokens.bounds[:-1] // ROW_IDS)) + 1
                for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), piece.num_rows]):
                    ids = tokens.ids[tokens.bounds[lo]:tokens.bounds[hi]]
                    words, offsets = simple8b.encode(ids)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([start], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), piece.column("doc_id").slice(lo, hi - lo)),
                        pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.array(np.diff(tokens.bounds[lo:hi + 1]))),
                        pa.array([offsets.astype("<u4").tobytes()]), pa.array([words.astype("<u8").tobytes()])], names)
                    part, start = part + 1, start + len(ids)

    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    sorted_docs = src.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    sorted_docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(kind=kind)).write.parquet(path)


def _located(rows: DataFrame) -> DataFrame:
    """Rows of a written folder with ``start``, the number of ids before each."""
    # one row per shard
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shards.select(F.col("shard").alias("_shard"), F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), rows.shard == offsets["_shard"]) \
        .withColumn("start", F.col("_before") + F.col("shard_start"))


def read_range(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """``start, ids``: the ids with places ``lo`` to ``hi`` (exclusive) in the whole
    stream, a row per stored row that holds some; put together by ``start`` they
    are the range.  Rows outside it are left out by their places, and of the others
    only the blocks that the range meets are decoded, found by the block offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, offsets, words in zip(*(batch.column(c).to_pylist() for c in ("start", "n_ids", "block_offsets", "words"))):
                ids = simple8b.decode_range(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4"), n, lo - start, hi - start)
                yield pa.RecordBatch.from_arrays([
                    pa.array([max(start, lo)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids.astype(np.int64)))], ["start", "ids"])

    held = _located(spark.read.parquet(path)).where((F.col("start") < hi) & (F.col("start") + F.col("n_ids") > lo))
    return held.select("start", "n_ids", "block_offsets", "words").mapInArrow(run, "start long, ids array<long>")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` of a written folder."""
    rows = spark.read.parquet(path)
    located = _located(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _documents(batch.slice(i, 1), names)

    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return located.select("doc_ids", "doc_lens", "n_ids", "start", "words") \
        .mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _documents(row: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    words = np.frombuffer(row.column("words")[0].as_py(), "<u8")
    ids = simple8b.decode(words, row.column("n_ids")[0].as_py()).astype("<u4")
    lens = row.column("doc_lens").flatten().to_numpy()
    end = np.append(0, np.cumsum(lens))
    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(end[:-1], end[1:])]
    out = [row.column("doc_ids").flatten(), pa.array(end[:-1] + row.column("start")[0].as_py()), pa.array(lens),
           pa.array(crc, pa.int64())]
    if len(names) > len(out):
        out.append(pa.ListArray.from_arrays(pa.array(end.astype(np.int32)), pa.array(ids.astype(np.int64))))
    return pa.RecordBatch.from_arrays(out, names)
