"""Texts as flat arrays of code points.

An Arrow string column becomes one uint32 array plus row offsets, so that per-character
work is done with whole-array operations instead of Python loops.  All kernels treat a
null text as an empty one; callers keep the validity mask where the difference matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier with a modular inverse: it makes polynomial hashes of runs positionless.
HASH_BASE = 0x9E3779B97F4A7C15
MASK64 = (1 << 64) - 1


def as_string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string())


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows one after the other, and the offsets of the rows (length rows + 1)."""
    array = as_string_array(column)
    if len(array) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint32), np.zeros(len(array) + 1, np.int64)
    raw = memoryview(data)[offsets[0] : offsets[-1]]
    starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    count = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(starts, out=count[1:])
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    return points, count[offsets - offsets[0]]


def unflatten(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of flatten."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = np.ones(len(points) + 1, np.int64)
    width[1:] += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    width[0] = 0
    ends = np.cumsum(width)[offsets]
    mask = None
    if valid is not None and not valid.all():
        mask = pa.array(valid).buffers()[1]
    array = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data), mask)
    return array.cast(pa.string())


def keep(points: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the points where mask holds, with offsets moved to match."""
    count = np.zeros(len(points) + 1, np.int64)
    np.cumsum(mask, out=count[1:])
    return points[mask], count[offsets]


def row_ids(offsets: np.ndarray) -> np.ndarray:
    """The row of every point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """HASH_BASE ** i and its modular inverse, for i < n."""
    base, inverse = np.uint64(HASH_BASE), np.uint64(pow(HASH_BASE, -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, step in ((up, base), (down, inverse)):
        if n:
            out[0] = 1
        filled, factor = 1, int(step)
        while filled < n:
            more = min(filled, n - filled)
            out[filled : filled + more] = out[:more] * np.uint64(factor)
            filled += more
            factor = factor * factor & MASK64
    return up, down


class RunHasher:
    """Hashes of any runs of a flat array in constant time each, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray) -> None:
        self.up, self.down = _powers(len(values) + 1)
        spread = mix(values.astype(np.uint64) + np.uint64(1))
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(spread * self.up[:-1], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + length)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def row_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Parts of a record batch with a bounded amount of text each, small enough for the arrays to stay in cache; one longer row is a part of its own."""
    size = batch.num_rows
    if size == 0:
        return
    array = as_string_array(batch.column(column))
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + size + 1]
    first = 0
    while first < size:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(size, max(first + 1, last))
        yield batch.slice(first, last - first)
        first = last
