"""Vectorised text kernels shared by the operators: slices, words, 64-bit hashes.

All kernels work on the UTF-8 buffer of an Arrow string column, so a slice of
documents is hashed with a fixed number of numpy passes instead of one Python
call per word.  Words are runs of bytes other than ``\\x20 \\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)

#: Space bytes and A-Z to a-z, as lookup tables over one byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element (a bijection of 64 bits)."""
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


#: A fixed pseudo-random 64-bit value for each byte value.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        m = max(n, 1 << 20)
        up, down = np.full(m, _BASE), np.full(m, _BASE_INV)
        up[0] = down[0] = 1
        _POWERS = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[0][:n], _POWERS[1][:n]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of at most ``max_bytes`` of text (or one row)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (one more than rows) of a string column; null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each row (one more than rows)."""
    n = len(data)
    word = ~SPACE[data]
    opens, closes = word.copy(), word.copy()
    if n:
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        opens[1:] &= ~word[:-1] | edge[1:n]
        closes[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the first word of each row (one more than rows)."""
    start, end, first = word_bounds(data, off)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), first


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles, A-Z lowered.

    Fewer words than ``width``: the whole sequence is the one shingle; no
    words: an empty set.
    """
    data, off = text_buffer(column)
    words, first = word_hashes(LOWER[data], off)
    n = len(words)
    whole = np.zeros(n, np.uint64)
    for j in range(width):
        m = max(0, n - width + 1)
        whole[:m] = mix(whole[:m] + words[j:j + m] + _M1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a:b - width + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for j in range(a, b):
                h = mix(h + words[j:j + 1] + _M1)
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signed(values) -> np.ndarray:
    """64-bit hashes as the signed longs that Spark columns hold."""
    return np.asarray(values, np.uint64).view(np.int64)
