"""Vectorised text primitives on Arrow buffers.

All operators of this subpackage that need more than SQL expressions work on
the bytes of a whole Arrow string column at once: no Python loop runs per word
or per byte.  A *chunk* is the bytes of several texts joined together, with the
offsets of the texts; :func:`chunks` keeps a chunk near ``CHUNK_BYTES`` so that
memory does not follow the size of an Arrow batch (one text is never split, so
a single giant text makes a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(0x5E551041))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_RNG.integers(1, 2**61)) * 8 + 5
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1 << max(12, int(n - 1).bit_length()), np.uint64)
        filled = 1
        while filled < len(out):
            out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        if len(out) <= 4 * CHUNK_BYTES:
            _powers[base] = out
        have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of a column."""
    limit = limit or CHUNK_BYTES
    if not len(column):
        return
    raw, off = buffers(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the range of its words.

    A word is a maximal run of bytes other than space and U+0009 to U+000D; it
    never crosses from one text into the next.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[(off > 0) & (off < n)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` reads the hash of any byte span."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power(_P, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * power(_P_INV, len(sums))[start])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(rolling(data), starts, ends)


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    n = len(values)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * power(_P, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * power(_P_INV, n)[: n - width + 1])


def owners(ranges: np.ndarray) -> np.ndarray:
    """For ranges [r0, r1, ...] of consecutive items, the text of each item."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, as sorted disjoint spans that do not touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:] - 1, len(end) - 1)]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in each window of ``width``, in linear time."""
    n = len(values)
    if n < width:
        return values[:0]
    if width == 1:
        return values
    pad = -n % width
    v = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])
