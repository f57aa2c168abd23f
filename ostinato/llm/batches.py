"""Arrow batches of texts as flat numpy arrays: the shared ground of the operators on whole texts.

Texts are UTF-8 bytes of many rows in one array plus row offsets. A null text counts as empty. Batches
are cut by bytes of text before any work, so memory follows `limit` and the longest single text, not the
number of rows that Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 4 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if buffers[2] is None else np.frombuffer(buffers[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most `limit` bytes in `column`, or one row that is longer."""
    _, offsets = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, column: str = "text",
              limit: int = LIMIT) -> DataFrame:
    """`fn` over parts of batches; it returns columns as arrow arrays, or None for no rows."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)
    return df.mapInArrow(run, schema)


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32))


def separators(data: np.ndarray) -> np.ndarray:
    """The white space that ends a word: space and U+0009 to U+000D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the alternating words and gaps of all rows (one more than runs), and which runs are words."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(0, bool)
    word = ~separators(data)
    start = np.empty(len(data), bool)
    start[0] = True
    np.not_equal(word[1:], word[:-1], out=start[1:])
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = np.flatnonzero(start)
    return np.append(first, len(data)), word[first]


def distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each span of `data`, and the distinct spans as a binary array in that numbering."""
    if len(bounds) < 2:
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    spans = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Words:
    """The words of a batch: number of each word in `vocabulary`, first byte, end, and the row bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        bounds, word = runs(data, offsets)
        codes, self.vocabulary = distinct(data, bounds)
        self.codes = codes[word].astype(np.int64)
        self.starts, self.ends = bounds[:-1][word], bounds[1:][word]
        self.rows = np.searchsorted(self.starts, offsets)        # word numbers at which the rows begin
        self.count = np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` between row bounds; 0 for empty rows."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo; null stays null."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))
