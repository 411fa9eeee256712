"""Vectorised text kernels over Arrow string buffers.

A batch of texts is one byte buffer with offsets; words are found and hashed with a handful of
numpy passes over that buffer, never one Python object per word. All hashes are fixed functions of
the bytes, so every executor agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; a longer single text is still handled whole.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but letters and digits; bytes of non-ASCII letters belong to words.
NON_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for k, b in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0 of its rows) for runs of rows of about CHUNK_BYTES; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): byte spans of all words; the words of row i are bounds[i]:bounds[i + 1]."""
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    if len(inside):
        before[0] = False
        before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(inside):
        after[-1] = False
        after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running sum over the buffer."""
    if not len(start):
        return np.zeros(0, U64)
    power, inverse = power_tables(len(data))
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * power, out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


_SHINGLE = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * _SHINGLE[0]
    for i in range(1, k):
        out = out + h[i : i + n] * _SHINGLE[i]
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """One hash of a whole short word sequence, tied to its length."""
    out = U64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = mix(np.array([out * _SHINGLE[1] + x], U64))[0]
    return np.array([out], U64)


def sorted_unique(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    if len(h) < 2:
        return h
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def word_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct k-word shingle hashes) of each text, ASCII lower case, words between white space.

    A text with 1 to k - 1 words has its whole word sequence as one shingle; without words, none.
    """
    for first, data, offsets in chunks(column):
        data = LOWER[data]
        start, end, bounds = words(data, offsets, SPACE)
        h = span_hashes(data, start, end)
        every = shingle_hashes(h, k)
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                yield first + i, sorted_unique(every[a : b - k + 1])
            else:
                yield first + i, sequence_hash(h[a:b]) if b > a else np.zeros(0, U64)
