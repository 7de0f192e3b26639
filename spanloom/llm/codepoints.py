"""Text columns as flat code-point arrays, and back, without a call per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer row is worked on alone.
CHUNK_BYTES = 1 << 20


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (length n + 1) of a string column; null rows are empty."""
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind, col = np.int32, col if pa.types.is_string(col.type) else col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def decode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with row offsets to code points with row offsets."""
    high = raw >= 0x80
    if not high.any():
        return raw.astype(np.uint32), offsets
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return points, starts[offsets]


def encode(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Code points with row offsets to a string column."""
    size = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=size[1:])
    data = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(size[offsets].tobytes()), pa.py_buffer(data)])


def has_non_ascii(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row whether any byte is outside of printable ASCII, tab and line ends."""
    odd = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_ODD[raw], out=odd[1:])
    return odd[offsets[1:]] > odd[offsets[:-1]]


_ODD = np.ones(256, bool)
_ODD[32:127] = False
_ODD[[9, 10, 13]] = False


def take_rows(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some rows, one after the other."""
    size = np.diff(offsets)[rows]
    to = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    index = np.repeat(offsets[:-1][rows] - to[:-1], size) + np.arange(to[-1])
    return raw[index], to
