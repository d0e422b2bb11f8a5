"""Arrow text columns as numpy arrays: byte views, word boundaries and slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of words: space and the control characters 9 to 13.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; row i is bytes[offsets[i]:offsets[i + 1]], null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    view = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return view, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in runs whose text has about most_bytes (a longer single text comes alone)."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
            last = min(max(last, first + 1), first + most_rows, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and for each row the number of words before it."""
    inside = ~SEPARATOR[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    start[heads] = inside[heads]
    end[tails] = inside[tails]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as one binary array, copied together."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    body = data[ranges_mask(len(data), starts, ends)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])


def ranges_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True inside the (disjoint, ascending) ranges."""
    step = np.zeros(n + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1  # an end never equals another end; where one equals the next start, they cancel
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE, _STEP = 0x9E3779B97F4A7C15, 4096


def _power_rows(base: int) -> tuple[np.ndarray, int]:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(_STEP - 1, np.uint64(base))]), pow(base, _STEP, 1 << 64)


_POWERS = tuple(_power_rows(b) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n of an odd base, or of its inverse, modulo 2**64: products of two short rows, so nothing that is
    kept grows with a text."""
    row, step = _POWERS[inverse]
    steps = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n // _STEP, np.uint64(step))])
    return (steps[:, None] * row).ravel()[: n + 1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same in every task: differences of one running polynomial sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(len(data), inverse=True)[starts])


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, begins): the words, each followed by one space, and where each begins (and the end of all)."""
    lengths = ends - starts
    begins = np.r_[0, np.cumsum(lengths + 1)]
    out = np.full(begins[-1], 32, np.uint8)
    body = data[ranges_mask(len(data), starts, ends)]
    out[np.arange(len(body)) + np.repeat(np.arange(len(starts)), lengths)] = body
    return out, begins
