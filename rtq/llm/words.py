"""Vectorised word arithmetic on Arrow string columns.

Texts are handled as one UTF-8 byte buffer with row offsets, so no Python
string is made per word.  Work goes in slices of bounded size; one text longer
than a slice forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
SLICE_BYTES = 1 << 20

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U64), "q": np.ones(1, U64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        for key, base in (("p", _ODD), ("q", _INV)):
            x = np.full(max(n, SLICE_BYTES + 1), base, U64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    parts = column.buffers()
    offsets = np.frombuffer(parts[1], np.int64 if large else np.int32)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None else np.empty(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, per row, the index of its first word (one more at the end)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    starts_at, ends_at = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    starts_at[:-1] = edge[:-1] & inside
    ends_at[1:] = edge[1:] & inside
    cut = np.unique(offsets)
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut - 1]]  # a row ends and the next begins without a separator
    starts_at[both] = ends_at[both] = True
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash per word that depends on the word's bytes only."""
    if not len(starts):
        return np.zeros(0, U64)
    p, q = _power_tables(len(data) + 1)
    value = _BYTE_VALUE[LOWER[data] if lower else data]
    value *= p[:len(data)]
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(value, out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return mix(h ^ (ends - starts).astype(U64))


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries (len(words) - k + 1 of them, or none)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, salt, U64)
    for j in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += words[j: j + n]
    return mix(out)


def by_text(batch: pa.RecordBatch, column: str = "text",
            lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch: (first row, bytes, starts, ends, first word per row, word hashes)."""
    data, offsets = buffers(batch.column(column))
    for a, b in slices(offsets):
        part, off = data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
        starts, ends, first = spans(part, off)
        yield a, part, starts, ends, first, word_hashes(part, starts, ends, lower)
