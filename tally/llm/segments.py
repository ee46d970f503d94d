"""Texts as runs of repeated segments, so that a tokenizer sees each one once.

A segment starts at a space that follows a character other than white space.
Such a place is a token boundary for both tokenizer kinds used here, so the
tokens of a text are the tokens of its segments in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tally.llm.common import strings, utf8_buffer


@dataclass
class Segments:
    """Distinct segments of a batch and where each document uses them."""

    distinct: pa.Array
    use: np.ndarray     # index into distinct, in text order
    bounds: np.ndarray  # rows + 1 positions in use


def _cut(data: np.ndarray, off: np.ndarray, safe: np.ndarray) -> Segments:
    start = np.zeros(len(data), bool)
    if len(data):
        start[1:] = (data[1:] == 0x20) & safe[:-1]
        start[off[:-1][off[:-1] < off[1:]]] = True
    at = np.flatnonzero(start)
    coded = strings(data, np.append(at, len(data))).dictionary_encode()
    return Segments(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False),
                    np.searchsorted(at, off))


def byte_level(col: pa.Array) -> Segments:
    """Segments, as a string column, for byte-level BPE, whose pre-tokenizer
    never joins a visible character to the space after it.  Cuts only where the byte before the space
    is visible ASCII or part of U+00C0..U+00FF; elsewhere segments stay longer."""
    data, off = utf8_buffer(pc.fill_null(col, ""))
    safe = (data > 0x20) & (data < 0x7F)
    if len(data) > 1:
        safe[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    return _cut(data, off, safe)


def metaspace(col: pa.Array) -> Segments:
    """Segments, as a string column, for a piece model that turns each space
    into U+2581 and puts one before the text; that one is put there as a space,
    so that every segment begins with one.  Cuts before any other space
    that follows neither a space nor U+2581 and is not a text's last character,
    so that only an empty text has a segment that is one space."""
    data, off = utf8_buffer(pc.binary_join_element_wise("", pc.fill_null(col, ""), " "))
    safe = data != 0x20
    if len(data) > 2:
        safe[2:] &= ~((data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2))
    safe[off[1:][np.diff(off) > 1] - 2] = False
    return _cut(data, off, safe)


@dataclass
class Tokens:
    """Token ids of a batch: those of row i are ids[bounds[i]:bounds[i + 1]]."""

    ids: np.ndarray
    bounds: np.ndarray


@dataclass
class Coded:
    """Ids of segments: those of segment i are flat[first[i]:first[i] + size[i]];
    ``flags`` is a row of marks per segment."""

    flat: np.ndarray
    first: np.ndarray
    size: np.ndarray
    flags: np.ndarray

    @classmethod
    def none(cls, marks: int = 0) -> Coded:
        return cls(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, marks), bool))

    @property
    def nbytes(self) -> int:
        return self.flat.nbytes + self.first.nbytes + self.size.nbytes + self.flags.nbytes

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in flat of the ids of these segments in turn, and where those of each begin and end."""
        n = self.size[which]
        stop = np.append(0, np.cumsum(n))
        return np.repeat((self.first[which] - stop[:-1]).astype(np.int32), n) + np.arange(stop[-1], dtype=np.int32), stop

    def of(self, which: np.ndarray) -> Coded:
        """Ids and marks of these segments alone."""
        take, stop = self.places(which)
        return Coded(self.flat[take], stop[:-1], self.size[which], self.flags[which])


class Memo:
    """Ids of the segments that a worker has met, up to ``most`` of them and
    ``room`` bytes; beyond that it goes on with those met again by then."""

    def __init__(self, encode, marks: int = 0, most: int = 1 << 20, room: int = 64 << 20):
        self.encode, self.marks, self.most, self.room = encode, marks, most, room
        self._forget()

    def _forget(self) -> None:
        self.known, self.coded = pa.array([], pa.large_string()), Coded.none(self.marks)

    def _keep(self, known: pa.Array, coded: Coded) -> None:
        self.known, self.coded = known, coded
        if len(known) > self.most or known.nbytes + coded.nbytes > self.room:
            self._forget()

    def __call__(self, found: Segments) -> tuple[Tokens, np.ndarray]:
        """Ids of each row, and the marks of each use of a segment."""
        at = pc.index_in(found.distinct, value_set=self.known)
        new = at.is_null()
        fresh = found.distinct.filter(new)
        old, more = self.coded, self.encode(fresh)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        every = Coded(np.concatenate([old.flat, more.flat]), np.concatenate([old.first, more.first + len(old.flat)]),
                      np.concatenate([old.size, more.size]), np.concatenate([old.flags, more.flags]))
        if len(self.known) + len(fresh) <= self.most and self.known.nbytes + fresh.nbytes + every.nbytes <= self.room:
            self.known, self.coded = pa.concat_arrays([self.known, fresh]), every
        else:
            again = pc.invert(new)
            self._keep(found.distinct.filter(again), every.of(place[again.to_numpy(zero_copy_only=False)]))
        use = place[found.use]
        take, stop = every.places(use)
        return Tokens(every.flat[take], stop[found.bounds]), every.flags[use]


def strung(segments: pa.Array, apart: np.ndarray, together: int) -> tuple[np.ndarray, list[str], list[str], list[int]]:
    """Order of the segments with those ``apart`` first, these as strings, the
    others strung together by so many, and the number in each string."""
    order = np.argsort(~apart, kind="stable")
    data, at = utf8_buffer(segments.filter(pa.array(~apart)))
    cuts, whole = at[::together].tolist() if len(at) > 1 else [], data.tobytes()
    groups = [whole[a:b].decode() for a, b in zip(cuts, [*cuts[1:], len(whole)]) if b > a]
    left = len(at) - 1
    return order, segments.filter(pa.array(apart)).to_pylist(), groups, [min(together, left - i) for i in range(0, left, together)]
