"""Suffix order of integer sequences and successor queries over it, with numpy.

Several sequences may lie behind one another; ``stop`` holds, for each place,
where its sequence ends.  A suffix that is a prefix of another comes first.
"""

from __future__ import annotations

import numpy as np


class Names:
    """Names of all substrings of length 1, 2, 4, ...

    ``rank[k][i]`` is the first place, in suffix order, of the suffixes that
    begin with the ``2**k`` symbols at ``i``, and ``size[k][i]`` how many those
    are; a substring cut off by its sequence's end is equal to no other.  Each
    level sorts only the places whose names of the level before occur twice.
    ``depth`` limits the levels; else they go on until every name is single.
    """

    def __init__(self, code: np.ndarray, stop: np.ndarray, depth: int = 64, keep: bool = True):
        n = len(code)
        order = np.argsort(code, kind="stable")
        rank, size = np.empty(n, np.int64), np.empty(n, np.int64)
        head, count = _groups(code[order])
        rank[order], size[order] = np.repeat(head, count), np.repeat(count, count)
        self.rank, self.size, step = [rank], [size], 1
        while len(self.rank) < depth or not keep and step < 1 << depth:
            at = np.flatnonzero(size > 1)
            if not len(at):
                break
            after = at + step
            second = np.where(after < stop[at], rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[at] * (n + 1) + second
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            before = rank[at]
            first, many = _groups(before)
            slot = before + np.arange(len(at)) - np.repeat(first, many)
            head, count = _groups(key)
            rank, size, step = rank.copy(), size.copy(), 2 * step
            rank[at], size[at] = np.repeat(slot[head], count), np.repeat(count, count)
            if keep:
                self.rank.append(rank)
                self.size.append(size)
            else:
                self.rank, self.size = [rank], [size]

    def suffix_array(self) -> np.ndarray:
        """Places in suffix order, once every name is single."""
        out = np.empty(len(self.rank[-1]), np.int64)
        out[self.rank[-1]] = np.arange(len(out))
        return out

    def common_ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i < j``."""
        n, far = len(self.rank[0]), np.zeros(len(i), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            a, b = i + far, j + far
            same = (b < n) & (self.rank[k][np.minimum(a, n - 1)] == self.rank[k][np.minimum(b, n - 1)])
            far[same] += 1 << k
        return far

    def common_behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of what lies before ``i < j``."""
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            a, b = i - far - (1 << k), j - far - (1 << k)
            same = (a >= 0) & (self.rank[k][np.maximum(a, 0)] == self.rank[k][np.maximum(b, 0)])
            far[same] += 1 << k
        return far


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(sorted_keys)))


class Wavelet:
    """Wavelet matrix of a sequence of integers from 0 to ``most``, its length if
    not given."""

    def __init__(self, values: np.ndarray, most: int | None = None):
        self.bits = range(max(1, int(len(values) if most is None else most).bit_length()) - 1, -1, -1)
        self.zeros, self.many = [], []
        for bit in self.bits:
            zero = (values >> bit & 1) == 0
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=count[1:])
            self.zeros.append(count)
            self.many.append(int(count[-1]))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in ``[lo, hi)`` are smaller than ``bound``."""
        out = np.zeros(len(lo), np.int64)
        over = bound >= 1 << len(self.bits)
        for bit, zeros, many in zip(self.bits, self.zeros, self.many):
            a, b = zeros[lo], zeros[hi]
            one = (bound >> bit & 1) == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, many + lo - a, a), np.where(one, many + hi - b, b)
        return np.where(over, np.iinfo(np.int64).max, out)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many values in ``[lo, hi)`` are smaller than ``value``, and how
        many equal ones lie before ``lo`` and before ``hi``."""
        less, base = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for bit, zeros, many in zip(self.bits, self.zeros, self.many):
            a, b, c = zeros[lo], zeros[hi], zeros[base]
            one = (value >> bit & 1) == 1
            less += np.where(one, b - a, 0)
            lo, hi, base = (np.where(one, many + x - z, z) for x, z in ((lo, a), (hi, b), (base, c)))
        return less, lo - base, hi - base

    def smallest(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The value in ``[lo, hi)`` that ``nth`` others come before."""
        out, nth = np.zeros(len(lo), np.int64), nth.copy()
        for bit, zeros, many in zip(self.bits, self.zeros, self.many):
            a, b = zeros[lo], zeros[hi]
            one = nth >= b - a
            nth -= np.where(one, b - a, 0)
            out += np.where(one, 1 << bit, 0)
            lo, hi = np.where(one, many + lo - a, a), np.where(one, many + hi - b, b)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, none: int) -> np.ndarray:
        """Smallest value of ``[lo, hi)`` that is ``least`` or more, else ``none``."""
        out = np.full(len(lo), none, np.int64)
        nth = self.below(lo, hi, least)
        there = np.flatnonzero(nth < hi - lo)
        out[there] = self.smallest(lo[there], hi[there], nth[there])
        return out
