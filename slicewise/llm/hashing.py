"""Vectorised hashes over the words of a batch of texts (used inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

U = np.uint64


def split_words(col: pa.Array) -> list[list[bytes]]:
    """Words of each text as bytes.  ``bytes.split`` cuts at exactly [\\x20\\x09-\\x0D]; a null
    text has none."""
    return [(x or b"").split() for x in col.cast(pa.binary()).to_pylist()]


def hash_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words' 64-bit hashes in one array, and the offsets of the texts in it."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    flat = np.fromiter((xxh3_64_intdigest(w) for t in texts for w in t), U, count=int(off[-1]))
    return flat, off


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every ``width`` consecutive values; doubling, so the cost
    grows with log(width).  Windows that cross texts are the caller's to leave out."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done = None, 0
    power, span = h, 1  # hash of ``span`` values from each place
    mult = base & (2**64 - 1)
    bits = width
    while bits:
        if bits & 1:
            if out is None:
                out = power
            else:  # what is done so far, then ``span`` more
                k = len(h) - done - span + 1
                out = out[:k] * U(mult) + power[done:done + k]
            done += span
        bits >>= 1
        if bits:
            k = len(h) - 2 * span + 1
            power = power[:k] * U(mult) + power[span:span + k]
            span *= 2
            mult = mult * mult & (2**64 - 1)
    return out[:n]
