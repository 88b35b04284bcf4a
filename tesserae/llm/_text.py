"""Array kernels over Arrow string buffers: slicing, tokenising and hashing without a Python object per token.

A *word* is a maximal run of ASCII letters, digits and non-ASCII characters; ASCII case is folded where asked.
With ``punct=True`` maximal runs of other visible characters are tokens too.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_FOLD = _BYTE.copy()
_BYTE_FOLD[65:91] = _BYTE[97:123]

_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 2
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _CLASS[_a:_b] = 1
_CLASS[128:] = 1
_CLASS_WORD = np.where(_CLASS == 1, 1, 0).astype(np.uint8)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def released(run: Callable) -> Callable:
    """``run`` over batches; when its task ends, the worker, which goes on living, gives freed memory back to the system."""

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it
                pass

    return run_and_release


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of the ordered pair (a, b)."""
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b + U64(0xA0761D6478BD642F)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1, from 0) of a string or binary array; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, raw_offsets, raw = column.buffers()
    width = np.int64 if big else np.int32
    offsets = np.frombuffer(raw_offsets, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows holding about ``most`` bytes; a longer row comes alone."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Tokens:
    """Hashes of the tokens of some documents, in order: ``hash``, ``doc`` (row of each), ``first`` (n + 1 offsets into both)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, punct: bool = False, spans: bool = False):
        n = len(offsets) - 1
        size = len(data)
        if size == 0:
            self.hash, self.doc, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
            self.begin = self.end = np.zeros(0, np.int64)
            return
        kind = (_CLASS if punct else _CLASS_WORD)[data]
        edge = np.empty(size + 1, bool)
        edge[0] = edge[size] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:size])
        edge[offsets] = True
        at = np.flatnonzero(edge)
        keep = kind[at[:-1]] != 0
        begin, end = at[:-1][keep], at[1:][keep]
        total = np.empty(size + 1, np.uint64)
        total[0] = 0
        np.cumsum((_BYTE_FOLD if fold else _BYTE)[data] * _power(_MULT, size), dtype=np.uint64, out=total[1:])
        self.hash = mix((total[end] - total[begin]) * _power(_INV, size)[begin])
        self.first = np.searchsorted(begin, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        if spans:
            self.begin, self.end, self._total = begin, end, total

    def prefix(self, size: int, where: np.ndarray) -> np.ndarray:
        """Hashes of the first ``size`` bytes of the tokens in the mask ``where``; needs ``spans``."""
        begin = self.begin[where]
        if not len(begin):
            return np.zeros(0, np.uint64)
        return mix(((self._total[begin + size] - self._total[begin]) * _power(_INV, len(self._total))[begin]) ^ U64(0x9FB21C651E98DF25))


def ngrams(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``n`` tokens inside one document."""
    h = tokens.hash
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = pair(out, h[k : len(h) - n + 1 + k])
    inside = tokens.doc[: len(h) - n + 1] == tokens.doc[n - 1 :]
    return out[inside], tokens.doc[: len(h) - n + 1][inside]
