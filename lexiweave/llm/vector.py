"""Word and shingle hashes of whole Arrow batches, with numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240501))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWERED = BYTE.copy()
LOWERED[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
LONGEST = 4096
PART = 500_000
POWERS = np.ones(LONGEST, np.uint64)
POWERS[1:] = BASE
POWERS = np.multiply.accumulate(POWERS)
COEFF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words (runs of other than ASCII white space) of the texts of an Arrow string array.

    data: bytes; start, end: of each word in data; first: index of each text's
    first word, one more at the end; hash: 64 bits of each word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string())
        buffers = texts.buffers()
        at = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] else np.zeros(0, np.uint8)
        at = at - at[0]
        solid = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[at] = True
        head = solid.copy()
        head[1:] &= ~solid[:-1] | edge[1:-1]
        tail = solid.copy()
        tail[:-1] &= ~solid[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, at)
        length = self.end - self.start
        self.hash = np.zeros(len(length), np.uint64)
        table = LOWERED if lower else BYTE
        upto = np.cumsum(length)
        lo = 0
        while lo < len(length):  # about PART bytes at a time, so that memory stays small for any text
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PART)))
            self._hash(lo, hi, length[lo:hi], table)
            lo = hi
        for i in np.flatnonzero(length > LONGEST):
            word = self.data[self.start[i] : self.end[i]].tobytes()
            self.hash[i] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")

    def _hash(self, lo: int, hi: int, length: np.ndarray, table: np.ndarray) -> None:
        piece = self.data[self.start[lo] : self.end[hi - 1]]
        begin = np.cumsum(length) - length
        inside = np.arange(begin[-1] + length[-1], dtype=np.int32) - np.repeat(begin.astype(np.int32), length)
        value = table[piece[~SPACE[piece]]] * POWERS[np.minimum(inside, LONGEST - 1)]
        self.hash[lo:hi] = mix(np.add.reduceat(value, begin) + length.astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that run over a text's end are to be left out."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out += h[j : len(h) - n + 1 + j] * COEFF[j]
        return mix(out)


def string_array(column) -> pa.Array:
    """One array without nulls of a batch's column."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
