"""Arrays that travel between tasks as binary columns.

A task gathers entries (hashes, places) of many texts and sends them as one row
for each target bucket, so that a shuffle moves few rows and the receiving task
sorts and groups with numpy.  Buckets are as many as shuffle partitions; a
bucket is grouped by Spark and holds its share of the entries only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Entries that a task gathers before it sends them on.
FLUSH = 1 << 19

SCHEMA = "bucket int, kind int, data binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_TYPES = [np.dtype(t) for t in ("<i8", "<u8", "<i4", "<u4", "<u2", "u1", "<f8")]
#: Types of numbers and places, whose high bytes are mostly alike: their first bytes stand together, then the second ones, as that presses well.
_PLANES = {_TYPES.index(np.dtype(t)) for t in ("<i8", "<i4", "<u4", "<u2")}
#: Entries of an array from which on that is done.
LONG = 64


def _bytes(a: np.ndarray, kind: int) -> bytes:
    if kind not in _PLANES or len(a) < LONG:
        return a.tobytes()
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    kinds = [_TYPES.index(a.dtype) for a in arrays]
    head = [len(arrays)]
    for kind, a in zip(kinds, arrays, strict=True):
        head += [kind, len(a)]
    return b"".join([np.array(head, "<i8").tobytes(), *[_bytes(a, kind) for kind, a in zip(kinds, arrays, strict=True)]])


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 * (1 + 2 * n), []
    for kind, length in head.tolist():
        size = _TYPES[kind].itemsize
        if kind in _PLANES and length >= LONG:
            planes = np.frombuffer(data, np.uint8, size * length, at).reshape(size, length)
            out.append(np.ascontiguousarray(planes.T).reshape(-1).view(_TYPES[kind]))
        else:
            out.append(np.frombuffer(data, _TYPES[kind], length, at))
        at += size * length
    return out


def rows(buckets: list[int], kinds: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], schema=_ARROW)


def dealt(bucket: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that send each entry to its bucket; entries of a bucket keep their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    arrays = tuple(a[order] for a in arrays)
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    last = np.r_[first[1:], len(b)]
    yield rows(b[first].tolist(), [kind] * len(first), [pack(*[a[x:y] for a in arrays]) for x, y in zip(first, last, strict=True)])


def table(buckets: list[int], kinds: list[int], data: list[bytes]) -> pa.Table:
    return pa.Table.from_batches([rows(buckets, kinds, data)])


def as_table(batches) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema=_ARROW)


def gathered(t: pa.Table, kind: int) -> list[np.ndarray] | None:
    """The arrays of all rows of a kind, joined; None if there are none."""
    parts = [unpack(d.as_buffer()) for k, d in zip(t.column("kind").to_pylist(), t.column("data"), strict=True) if k == kind]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal keys."""
    if not len(key):
        z = np.zeros(0, np.int64)
        return z, z
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)])


class Gather:
    """Arrays gathered slice by slice until there are ``FLUSH`` entries."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *arrays: np.ndarray) -> bool:
        self.parts.append(arrays)
        self.held += len(arrays[0])
        return self.held >= FLUSH

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.held = [], 0
        return out
