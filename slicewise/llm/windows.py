"""Anchors of fixed-length windows, for finding equal windows across documents.

A window of ``length`` symbols is found by its anchor: the smallest (leftmost of equals) hashed
``k``-gram inside it.  Equal windows have equal anchors at equal offsets, so windows need to be
compared only where their anchors' hashes meet, and neighbouring windows share an anchor: about
two anchors per ``length - k + 2`` symbols stand for all windows.  The span of an anchor is the
union of the windows it stands for; its hash decides all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from slicewise.llm.hashing import U, mix, rolling

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class SpanHash:
    """Polynomial hash (mod 2^64) of any span of an array of 64-bit values."""

    def __init__(self, values: np.ndarray, which: int):
        n, base = len(values), _BASE[which]
        v = mix(values + U(which + 1))
        self.inverse = np.full(n + 1, pow(base, -1, 2**64), U)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        powers = np.full(n + 1, base, U)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(v * powers[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


@dataclass
class Anchors:
    """Anchors of a batch; positions are places in the batch's flat array."""

    owner: np.ndarray   # number of the text
    at: np.ndarray      # place of the k-gram
    hash: np.ndarray    # its hash
    first: np.ndarray   # start of the first window the anchor stands for
    last: np.ndarray    # start of the last one


def anchors(flat: np.ndarray, off: np.ndarray, length: int, k: int) -> Anchors:
    """Anchors of all windows of ``length`` symbols that lie inside one text."""
    w, n = length - k + 1, len(flat)
    none = np.zeros(0, np.int64)
    if n < length:
        return Anchors(none, none, none.astype(U), none, none)
    h = mix(rolling(flat, k, _BASE[0]))
    # upper half of the hash, then the place: the smallest is the leftmost of equals
    low, span = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U), 1
    while span * 2 <= w:  # smallest of 2, 4, 8, ... neighbours
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[:n - length + 1], low[w - span:w - span + n - length + 1])
    idx = (low & U(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), size)
    valid = owner[:len(idx)] == owner[length - 1:length - 1 + len(idx)]
    start = np.flatnonzero(valid)
    if not len(start):
        return Anchors(none, none, none.astype(U), none, none)
    at, own = idx[start], owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1
    return Anchors(own[begin], at[begin].astype(np.int64), h[at[begin]], start[begin], start[end])


def span_keys(a: Anchors, one: SpanHash, length: int) -> np.ndarray:
    """Hash of each anchor's span and of the anchor's place in it."""
    return mix(one.of(a.first, a.last + length) + (a.at - a.first).astype(U))


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the inclusive ranges, and the range each belongs to."""
    n = last - first + 1
    which = np.repeat(np.arange(len(n)), n)
    start = np.cumsum(n) - n
    return np.arange(int(n.sum())) - start[which] + first[which], which


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal disjoint ones (touching spans join), sorted."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    begin = np.flatnonzero(new)
    return s[begin], e[np.append(begin[1:], len(s)) - 1]
