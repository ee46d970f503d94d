"""Simple-8b: varying counts of integers packed into 64-bit words.

A word holds a selector in its top 4 bits and, from the low end of the other 60
bits, as many equal-width values as the selector says.  Values are coded in
blocks of ``BLOCK``; each starts at a fresh word, so any block is decoded alone.
A value of more than 60 bits takes an escape: a word with selector ``ESCAPE``,
then a word that is the value itself.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Values per word, by selector; their width is 60 // count bits. A fixed table of the method.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 15
_SHIFT, _LOW = np.uint64(60), np.uint64((1 << 60) - 1)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    out = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    wide = np.flatnonzero(high)
    out[wide] = np.frexp(high[wide].astype(np.float64))[1] + 32
    return out


def _selectors(bits: np.ndarray, block: int) -> np.ndarray:
    """For a word that starts at each value, its selector: the most values that
    fit, without passing the end of the block."""
    n = len(bits)
    best = np.full(n, ESCAPE, np.uint8)
    best[bits <= 60] = len(COUNTS) - 1
    place = np.arange(n, dtype=np.int32)
    left = np.minimum(block - place % block, n - place)
    widest, have = bits.copy(), 1  # widest value among the next `have`
    for selector in range(len(COUNTS) - 2, -1, -1):
        count = int(COUNTS[selector])
        while have < count:
            if have < n:
                widest[:n - have] = np.maximum(widest[:n - have], bits[have:])
            have += 1
        fits = (widest <= WIDTHS[selector]) & (left >= count)
        if not fits.any():  # then no longer run of narrower values fits either
            break
        best[fits] = selector
    return best


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the offset of each block's first word (one more at the end)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    best = _selectors(_bits(values), block)
    step = np.append(COUNTS, [0, 1])[best]
    first = np.arange(0, n, block)
    end = np.minimum(first + block, n)
    at, starts = first.copy(), []
    live = np.arange(len(first))
    while len(live):  # all blocks advance by one word at a time
        starts.append(at[live])
        at[live] += step[at[live]]
        live = live[at[live] < end[live]]
    start = np.sort(np.concatenate(starts))
    chosen = best[start]
    escaped = chosen == ESCAPE
    size = 1 + escaped
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = chosen.astype(np.uint64) << _SHIFT
    words[place[escaped] + 1] = values[start[escaped]]
    for selector in np.unique(chosen[~escaped]):
        mine = np.flatnonzero(chosen == selector)
        head, slot = start[mine], place[mine]
        for k in range(COUNTS[selector]):
            words[slot] |= values[head + k] << np.uint64(k * WIDTHS[selector])
    return words, np.append(place[np.searchsorted(start, first)], len(words))


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a run of whole blocks."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> _SHIFT).astype(np.int64)
    raw = _raw_words(selector)
    count = np.append(COUNTS, [0, 0])[selector]
    count[raw] = 1
    place = np.cumsum(count) - count
    out = np.zeros(n, np.uint64)
    out[place[raw]] = words[raw]
    for s in np.unique(selector[~raw & (selector < len(COUNTS))]):
        mine = ~raw & (selector == s)
        body, slot = words[mine] & _LOW, place[mine]
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[slot + k] = (body >> np.uint64(k * WIDTHS[s])) & mask
    return out


def decode_range(words: np.ndarray, offsets: np.ndarray, n: int, lo: int, hi: int, block: int = BLOCK) -> np.ndarray:
    """Values ``lo`` to ``hi`` (exclusive) of ``n``; only the words of blocks that
    hold some of them are decoded."""
    lo, hi = max(lo, 0), min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.uint64)
    first, last = lo // block, -(-hi // block)
    skip = first * block
    return decode(words[offsets[first]:offsets[last]], min(last * block, n) - skip)[lo - skip:hi - skip]


def _raw_words(selector: np.ndarray) -> np.ndarray:
    """Which words are values behind an escape; such a value's own top bits may
    look like an escape too, so runs of them alternate."""
    raw = np.zeros(len(selector), bool)
    mark = np.flatnonzero(selector == ESCAPE)
    if len(mark):
        run = np.append(True, np.diff(mark) > 1)
        begin = mark[run][np.cumsum(run) - 1]
        raw[mark[(mark - begin) % 2 == 0] + 1] = True
    return raw
