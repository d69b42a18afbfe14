"""Words and word shingles of whole Arrow columns, in numpy.

Words are runs of characters other than ASCII white space, lower-cased, without ASCII punctuation at their ends (a run of
punctuation alone stays as it is). A shingle is five words in a row; a text of one to four words is one shingle. Both are
64-bit hashes. No step looks at one text at a time, and a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5

_INNER = np.ones(256, dtype=bool)
_INNER[:128] = [chr(i).isalnum() for i in range(128)]
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = np.random.default_rng(5).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = [powers(_BASE, 1), powers(_INVERSE, 1)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        _POWERS[:] = [powers(_BASE, n), powers(_INVERSE, n)]
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after another, and the n + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of some ``size`` bytes each, which the processor's cache holds; a longer text is a part of its own."""
    if not len(column):
        return
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield start, column.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield start, column.slice(start)


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Hashes of all words, the n + 1 offsets of the rows in them, and (bytes, first, end, rows' offsets in the bytes)."""
    data, offsets = as_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")) if lower else column)
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not((data - np.uint8(9) <= 4) | (data - np.uint8(28) <= 4), out=inside[1:-1])  # spaces are 9 to 13 and 28 to 32
    cut = np.zeros(len(data) + 1, dtype=bool)  # a word ends where its text ends
    cut[offsets] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    first, end = trimmed(data, first, end)
    base, inverse = _tables(len(data) + 1)[:2]
    sums = np.zeros(len(data) + 1, np.uint64)
    value = data.astype(np.uint64)
    value += np.uint64(1)
    value *= base[: len(data)]
    np.cumsum(value, out=sums[1:])
    return mixed((sums[end] - sums[first]) * inverse[first]), np.searchsorted(first, offsets), (data, first, end, offsets)


def trimmed(data: np.ndarray, first: np.ndarray, end: np.ndarray, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at their ends; those of punctuation alone as they are. Most words have little of it, so
    it is taken off byte by byte; where that takes more than ``steps``, the bytes that stay are counted instead."""
    a, b = first.copy(), end.copy()
    left = np.flatnonzero(~_INNER[data[a]])
    for _ in range(steps):
        a[left] += 1
        left = left[a[left] < end[left]]
        left = left[~_INNER[data[a[left]]]]
    none = a >= end
    right = np.flatnonzero(~none & ~_INNER[data[end - 1]])
    for _ in range(steps):
        b[right] -= 1
        right = right[~_INNER[data[np.maximum(b[right] - 1, 0)]]]
    if not len(left) and not len(right):
        return np.where(none, first, a), np.where(none, end, b)
    inner = _INNER[data]
    at, upto = np.flatnonzero(inner), np.concatenate(([0], np.cumsum(inner)))
    some = upto[end] > upto[first]
    if not len(at):
        return first, end
    return np.where(some, at[np.minimum(upto[first], len(at) - 1)], first), np.where(some, at[np.maximum(upto[end] - 1, 0)] + 1, end)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, repeats kept, and the n + 1 offsets of the rows in them."""
    hashes, offsets, _ = words(column)
    n = np.diff(offsets)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    out = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    start = offsets[row] + np.arange(out[-1]) - out[row]
    padded = np.concatenate((hashes, np.zeros(WORDS, np.uint64)))
    total = np.zeros(len(start), np.uint64)
    for k in range(WORDS):
        word = padded[start + k] * _MIX[k]
        total += np.where(start + k < offsets[row + 1], word, np.uint64(k))
    return mixed(total), out
