"""Periodic runs of words, by internal pattern matching.

A run is a stretch of words with smallest period ``q`` and at least
``max(shortest, 2 q)`` words that no neighbouring word extends.  Its first part,
all but the last ``q`` words, holds a whole dyadic block: ``2**k`` words that
start at a multiple of ``2**(k - 1)``.  The block occurs again ``q`` words on.  So
each block asks, in its window of the distances that its level is responsible
for, for the next occurrence of its words: the suffixes that begin with the block
are an interval of the suffix array, and a wavelet tree over that array gives the
smallest place of an interval past a bound.  Occurrences less than half a block
apart form arithmetic progressions, taken whole.  Those in the block's own
periodic stretch belong to the stretch's period, all other distances are
candidate periods; common extensions to both sides give each one's run.  Of
equal stretches the smallest period is the run's.

Texts of a slice are worked on together, with words named per document, and only
those in which some block of four words occurs twice.  A text's work is
O(n log n) for n words, its memory O(n log n) numbers at most.

``find_runs`` gives ``doc_id, n_words, runs, collapsed``.  Defined results: null
text counts as empty; a text without words has no runs and collapses to ''; words
that any run holds after its first period are dropped; repeated rows give
repeated rows; null ids stay null; other columns are ignored; an empty table
gives an empty table.  ``repeat`` may change the words of a text beforehand.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import pick, strings, text_slices, utf8_buffer
from tally.llm.suffixes import Names, Wavelet

SHORTEST = 12
#: Bytes of text that are worked on together.
SLICE = 4 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

RUN = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code of each word of a column of texts, equal for equal words, and the
    first word of each row, with the number of all words at the end."""
    data, off = utf8_buffer(col)
    word = ~_WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[edge], last[edge - 1] = word[edge], word[edge - 1]
    starts = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - starts
    words = strings(data[word], np.append(0, np.cumsum(size)))
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, off)


def runs_of(code: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """``row, start, length, period`` of all runs by row, start and period; the
    symbols of row r are ``code[bounds[r]:bounds[r + 1]]``."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(row):
        return (np.zeros(0, np.int64),) * 4
    own = row * (int(code.max()) + 1) + code
    names = Names(own, bounds[1:][row], depth=3)
    some = np.zeros(len(bounds) - 1, bool)
    if len(names.size) == 3:
        some[row[names.size[2] > 1]] = True
    pick_ = some[row]
    if not pick_.any():
        return (np.zeros(0, np.int64),) * 4
    rows = np.flatnonzero(some)
    cuts = np.append(0, np.cumsum(np.diff(bounds)[rows]))
    found = _runs(own[pick_], cuts, shortest)
    which = np.searchsorted(cuts, found[0], "right") - 1
    return rows[which], found[0] - cuts[which], found[1] - found[0], found[2]


def _runs(code: np.ndarray, cuts: np.ndarray, shortest: int) -> np.ndarray:
    """Start, end and period of all runs, as rows of a sorted table."""
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    stop = cuts[1:][row]
    names = Names(code, stop)
    tree = Wavelet(names.suffix_array())
    found = []
    place = np.arange(len(code)) - cuts[row]
    for k in range(2, len(names.rank)):
        rank, size = names.rank[k], names.size[k]
        block = np.flatnonzero((size > 1) & (place % (1 << k - 1) == 0))
        if len(block):
            nearest, farthest = (1 if k == 2 else (3 << k - 1) - 1), (3 << k) - 2
            at, period = _distances(names, tree, block, rank[block], size[block], 1 << k, nearest, farthest)
            start = at - names.common_behind(at, at + period)
            end = at + period + names.common_ahead(at, at + period)
            long = end - start >= np.maximum(shortest, 2 * period)
            found.append(np.unique(np.stack([start, end, period])[:, long], axis=1))
    if not found:
        return np.zeros((3, 0), np.int64)
    every = np.concatenate(found, axis=1)
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    new = np.ones(every.shape[1], bool)
    new[1:] = (every[:2, 1:] != every[:2, :-1]).any(axis=0)
    every = every[:, new]
    return every[:, np.lexsort((every[2], every[0]))]


def _distances(names: Names, tree: Wavelet, block: np.ndarray, rank: np.ndarray, size: np.ndarray,
               width: int, nearest: int, farthest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block and the distance of an occurrence in its window, without
    those of the block's own periodic stretch past the first."""
    none = len(names.rank[0]) + farthest + 1
    at, far = [], []
    lo, hi, limit = rank, rank + size, block + farthest

    # the block's own stretch
    step = tree.successor(lo, hi, block + 1, none) - block
    own = np.flatnonzero(step <= width // 2)
    there = own[step[own] >= nearest]
    at.append(block[there])
    far.append(step[there])
    least = block + nearest
    end = block[own] + step[own] + names.common_ahead(block[own], block[own] + step[own])
    least[own] = np.maximum(least[own], end - width + 1)

    # other occurrences, progressions at a time
    while len(block):
        place = tree.successor(lo, hi, least, none)
        live = np.flatnonzero(place <= limit)
        block, lo, hi, limit, place = block[live], lo[live], hi[live], limit[live], place[live]
        step = tree.successor(lo, hi, place + 1, none) - place
        last = place.copy()
        row = np.flatnonzero(step <= width // 2)
        end = place[row] + step[row] + names.common_ahead(place[row], place[row] + step[row])
        last[row] = end - width
        step = np.where(step <= width // 2, step, 1)
        many = (np.minimum(last, limit) - place) // step + 1
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at.append(np.repeat(block, many))
        far.append(np.repeat(place - block, many) + nth * np.repeat(step, many))
        least = last + 1
    return np.concatenate(at), np.concatenate(far)


def planted(doc_id, n: int) -> np.ndarray | None:
    """Which word stands at each of n places, for the tenth of ids whose texts
    are made periodic; else None."""
    if doc_id is None or n == 0 or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Places that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.flatnonzero(np.cumsum(depth[:-1]) == 0)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
              repeat: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of each whole text by start
    and period, and its kept words joined by one space.  ``repeat(id, n)`` may
    give the word that stands at each of a text's n places.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                yield _slice(part)

    def _slice(part: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(part.column("text"), "")
        code, bounds = word_codes(text)
        n = np.diff(bounds)
        order: dict[int, np.ndarray] = {}
        if repeat is not None:
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                if (at := repeat(doc_id, int(n[i]))) is not None:
                    order[i] = at
                    code[bounds[i]:bounds[i + 1]] = code[bounds[i]:bounds[i + 1]][at]
        row, start, length, period = runs_of(code, bounds, shortest)
        cut = np.searchsorted(row, np.arange(len(n) + 1))
        changed = sorted({*order, *row.tolist()})
        collapsed = [b" ".join(t.split()) for t in text.cast(pa.binary()).to_pylist()]
        for i in changed:
            s = slice(cut[i], cut[i + 1])
            kept = _kept(int(n[i]), start[s], length[s], period[s])
            words = collapsed[i].split(b" ")
            collapsed[i] = b" ".join([words[j] for j in (order[i][kept] if i in order else kept).tolist()])
        runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"]))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n, pa.int64()), runs.cast(_RUN), pa.array(collapsed, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])

    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256`` of the result of ``find_runs``: the longest run (ties:
    smallest start, then period) and hashes of all runs and of the kept words."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = -F.col("best.l"), F.col("best.p")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), length.alias("length"),
        period.alias("period"), F.expr("(1000 * -best.l) div best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
