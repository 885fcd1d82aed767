"""Word hashes of whole texts, computed on the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than space and \\t..\\r; with ``lower``,
A-Z count as a-z.  Each word gets a 64-bit hash that depends on its bytes only,
so every task and every run names a word alike.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; a longer word is still hashed whole.
SEGMENT = 1 << 18

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_P = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SEGMENT)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(size, _U(base))
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, row offsets into them) of a string column; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[first:last]
    offsets = offsets - first
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)      # a row begins here
    edge[offsets] = True
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + SEGMENT, side="right")))
        a, b = s[i], e[j - 1]
        out[i:j] = _hash_spans(data[a:b], s[i:j] - a, e[i:j] - a)
        i = j
    return out, np.searchsorted(s, offsets)


def give_back() -> None:
    """Hands memory that is free back to the system: a Python worker outlives its task, and
    what it holds on to adds to what the executor needs in all stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each hold about ``limit`` bytes (one row at least)."""
    give_back()                     # what the task before has left
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            base = size[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j
    batch = None
    give_back()


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` neighbouring values."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, _U(n))
    for i in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[i:m + i])
    return out
