"""Words of a whole Arrow batch of texts as numpy arrays: no loop over words.

Words are maximal runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``).
A word's hash is a sum of byte values times powers of an odd base, taken from one
running sum over the batch and then mixed to 64 good bits; n-grams combine them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BASE_2 = 0xC2B2AE3D27D4EB4F | 1
_INVERSE_2 = pow(_BASE_2, -1, 1 << 64)
_VALUES, _VALUES_2 = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n + 1, 1 << 20), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > 1 << 22:  # one very long text: do not hold on to its table
            return have
        _tables[base] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; ``second`` gives an independent one."""
    base, inverse, values = (_BASE_2, _INVERSE_2, _VALUES_2) if second else (_BASE, _INVERSE, _VALUES)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * _powers(base, n)[:n], out=total[1:])
    span = (total[ends] - total[starts]) * _powers(inverse, n + 1)[starts]
    return mix(span + (ends - starts).astype(np.uint64))


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of an array (null counts as empty) and their n+1 offsets."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("") if arr.null_count else arr
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)
    off = off[arr.offset:arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


class Words:
    """Words of the texts of one string array (null counts as empty).

    ``data``: bytes of all texts; ``doc_at``: n+1 byte offsets of the texts;
    ``starts, ends``: byte offsets of each word; ``word_at``: n+1 word offsets.
    ``cut`` tells for each byte value whether it parts words."""

    def __init__(self, arr: pa.Array, lower: bool = False, cut: np.ndarray = _SPACE):
        self.data, self.doc_at = bytes_of(arr)
        if lower:
            self.data = _LOWER[self.data]
        self.n = len(arr)
        inside = ~cut[self.data]
        self._cut = cut
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = self.doc_at[:-1]
        at = at[at < len(inside)]
        first[at] = inside[at]          # a text's first byte begins a word of its own
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        end = self.doc_at[1:] - 1
        end = end[end >= 0]
        last[end] = inside[end]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.word_at = np.searchsorted(self.starts, self.doc_at)
        self.n_words = np.diff(self.word_at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return span_hashes(self.data, self.starts, self.ends)

    def strings(self) -> pa.Array:
        """All words, as binary strings."""
        at = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int32)
        body = self.data[~self._cut[self.data]]
        return pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(at), pa.py_buffer(body)])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def grams(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words that lie in one text, and n+1 offsets of
        each text's runs among them.  Run j of text d starts at word ``word_at[d] + j``."""
        counts = np.maximum(self.n_words - size + 1, 0)
        at = np.concatenate(([0], np.cumsum(counts)))
        if not at[-1]:
            return np.zeros(0, np.uint64), at
        whole = hashes[:len(hashes) - size + 1].copy()
        for j in range(1, size):
            whole *= _U(0xD6E8FEB86659FD93)
            whole += hashes[j:len(hashes) - size + 1 + j]
        keep = np.zeros(len(hashes) + 1, np.int64)   # cut runs that cross a text's end
        has = counts > 0
        np.add.at(keep, self.word_at[:-1][has], 1)
        np.add.at(keep, (self.word_at[:-1] + counts)[has], -1)
        return mix(whole[np.cumsum(keep)[:len(whole)] > 0]), at

    def text(self, doc: int) -> bytes:
        return self.data[self.doc_at[doc]:self.doc_at[doc + 1]].tobytes()


def per_doc_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the offsets ``at`` (n+1 of them)."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]
