"""Whole-batch text kernels on numpy: words, hashes and per-document sums.

Executors hand over Arrow batches.  They are cut into chunks of bounded size
(one document is never cut), and every kernel here works on all bytes of a
chunk at once instead of looping over words in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at once, so that the arrays made of them stay in a core's cache.
#: A single longer document is its own chunk.
CHUNK_BYTES = 1 << 18

#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_MASK = (1 << 64) - 1

#: Bytes between words: space and \t \n \v \f \r.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Everything ASCII that is neither a letter nor a digit.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NON_ALNUM[_a:_b] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(fold: bool) -> np.ndarray:
    t = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
    if fold:
        t[65:91] = t[97:123]
    return t


RAW, FOLDED = _table(False), _table(True)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 0..n-1, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_MULT, _INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and n+1 offsets; a null is an empty text."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    elif pa.types.is_string(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_string()), np.int64
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        dead = np.asarray(column.is_null())
        if (off[1:] - off[:-1])[dead].any():
            keep = np.where(dead, 0, off[1:] - off[:-1])
            raw = np.concatenate([raw[off[i] : off[i + 1]] for i in np.flatnonzero(~dead)] or [raw[:0]])
            off = np.concatenate([[0], np.cumsum(keep)])
            return raw, off
    return raw[off[0] : off[-1]], off - off[0]


def map_batches(rows: DataFrame, run: Callable, schema: object) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_BYTES``, or one row: 10,000 whole texts at once would be held twice, by the JVM and by Python.

    The session's bound is lowered where it is larger, and stays lowered.
    """
    spark = rows.sparkSession
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most ``limit`` bytes of text, or one document."""
    for batch in batches:
        data, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def word_spans(data: np.ndarray, off: np.ndarray, separators: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text where its words begin (n+1)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    inner = off[(off > 0) & (off < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = RAW) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans anywhere get equal hashes.

    A polynomial over random byte values, read off one running sum, then mixed
    with the length.
    """
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    power, inverse = _powers_to(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[data] * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[np.minimum(starts, n - 1)]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h)


def running(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0..n values."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def column_of(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))
