"""Words of whole texts as numpy arrays over Arrow buffers.

A word is a maximal run of bytes outside space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every text the number of words before it (n + 1 values)."""
    ink = ~SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = ink[inner]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    last = inner[inner > 0] - 1
    ends[last] = ink[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of every text."""
    data, offsets = text_buffer(column)
    return np.diff(word_bounds(data, offsets)[2])


def slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most max_bytes of a string or binary column, or a single row."""
    column = batch.column(batch.schema.get_field_index(text))
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def blocks(ends: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of words whose ends lie within `size` bytes of the range's first word, or single longer words."""
    low = 0
    while low < len(ends):
        begin = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, begin + size, side="right")), low + 1)
        yield low, high
        low = high


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words one after the other, one space after each; start and end byte of every word in there.

    Block by block, so that the index arrays stay small for a very long text too.
    """
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int((lengths + 1).sum()), 32, dtype=np.uint8)
    for low, high in blocks(ends):
        own = lengths[low:high]
        place = np.arange(int(own.sum()))
        before = np.cumsum(own) - own
        out[np.repeat(to[low:high] - before, own) + place] = data[np.repeat(starts[low:high] - before, own) + place]
    return out, to, to + lengths
