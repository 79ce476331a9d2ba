"""Vectorised word tables over Arrow text columns, shared by the text operators.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Every function works on whole texts; a batch is
only cut between rows, so that temporaries stay near ``limit`` bytes or near one text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of UTF-8 that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80


def text_array(column) -> pa.Array:
    """A column as large_binary without nulls; a null text reads as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    return column.fill_null("").cast(pa.large_binary())


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes, each with its texts as large_binary."""
    texts = text_array(batch.column(column))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary array and the offsets of its rows in them."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def codes_of(values) -> np.ndarray:
    """Dense codes of equal values, in order of first sight."""
    return np.asarray(pa.array(values).dictionary_encode().indices)


class Words:
    """Words of some texts: bounds in ``data``, the row of each, and counts by row."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        data, self.offsets = raw(texts)
        self.data = LOWER[data] if lower else data
        self.n_docs = len(texts)
        solid = ~SPACE[self.data]
        first = np.zeros(len(data) + 1, bool)  # a row starts here
        first[self.offsets] = True
        starts = solid.copy()
        starts[1:] &= ~solid[:-1] | first[1:-1]
        self.starts = np.flatnonzero(starts)
        ends = solid
        ends[:-1] &= ~solid[1:] | first[1:-1]
        self.ends = np.flatnonzero(ends) + 1
        bounds = np.searchsorted(self.starts, self.offsets)
        self.bounds = bounds  # words of row i are bounds[i]:bounds[i + 1]
        self.counts = np.diff(bounds)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def split(self, at: np.ndarray) -> None:
        """Cut words in two at places inside them."""
        self.starts, self.ends = (np.sort(np.concatenate([x, at]), kind="stable") for x in (self.starts, self.ends))
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        return sums(flags, self.offsets)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes without what lies between them, and their offsets."""
        lengths = self.ends - self.starts
        offsets = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        inside = ~SPACE[self.data]
        return self.data[inside], offsets

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Code of each word, and the distinct words by code."""
        data, offsets = self.packed()
        array = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        return np.asarray(array.indices), array.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for every i, empty ranges included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:], dtype=np.int64)
    return total[offsets[1:]] - total[offsets[:-1]]
