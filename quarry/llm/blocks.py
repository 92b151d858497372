"""Helpers for tasks that treat the texts of an Arrow batch as one byte array.

A task gets Arrow record batches from Spark, cuts them into slices of a few
megabytes and works on each slice with numpy, so memory follows the slice and
not the partition.  Only a single text longer than a slice is held alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice.
SLICE_BYTES = 1 << 18

U64 = np.uint64
BASE = 0x9E3779B97F4A7C55
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: entry i covers the first i bytes."""
    n = len(buf)
    out = np.zeros(n + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(n)[0], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each byte span, the same wherever the span lies."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def gram_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, U64)
    return (prefix[k:] - prefix[:n]) * powers(n)[1]


def window_min(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """Minimum (or op) of each w neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = op(out[: len(out) - (w - have)], out[w - have :])
    return out


@dataclass
class Slice:
    """Some rows of a batch; their texts lie in buf, row i at off[i] to off[i + 1]."""

    rows: pa.RecordBatch
    buf: np.ndarray
    off: np.ndarray

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if not len(column) or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut record batches into slices of about ``limit`` bytes of text."""
    for batch in batches:
        buf, off = text_buffers(batch.column(text))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
            b = min(max(b, a + 1), batch.num_rows)
            yield Slice(batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a])
            a = b


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+`` and the first word of each row.

    A word never crosses rows.  The third array has one entry more than rows.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~SPACES[buf]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < n)]
    begins[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
