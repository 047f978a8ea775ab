"""Texts of an Arrow batch as numpy arrays, for operators that work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A batch is worked on in slices of about so many bytes of text, which bounds the memory of a task.
SLICE_BYTES = 4 << 20


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (with the end as the last entry)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has about ``limit`` bytes of text; one longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = as_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The pieces of ``data`` between consecutive offsets, without a copy."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) with A-Z in lower case, and where each text's words begin."""
    capital = (data >= 65) & (data <= 90)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    starts[begins] = inside[begins]
    place = np.concatenate([[0], np.cumsum(inside)])
    where = np.flatnonzero(starts)
    ends = np.concatenate([place[where], place[-1:]])
    count = np.concatenate([[0], np.cumsum(starts)])
    return binary_array((data + capital * np.uint8(32))[inside], ends), count[offsets]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive parts of a numeric array as one binary value each."""
    width = values.dtype.itemsize
    return binary_array(values.view(np.uint8), offsets * width)


def small_binary(values: pa.Array) -> pa.Array:
    return values.cast(pa.binary())
