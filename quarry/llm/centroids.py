"""Centroid clustering with heap-ordered bounds.

Vectors become whole numbers and lie in blocks of ``BLOCK`` rows, written once
in buckets by block.  Beside them stands a small state: for each block and
cluster a heap of its vectors, ordered by the gap between the distance to the
second nearest centroid and that to the nearest one.  A vector's key is its gap
when it was last looked at plus its cluster's drift at that time; the drift
adds up how far, since the start, the cluster's own centroid and the one that
moved most besides could have come nearer.  While a key is above the drift, no
other centroid can be as near, so a round pops only the vectors whose gap has
expired, measures them exactly against all centroids and pushes them into the
heap of their cluster.  Sums change by the vectors that moved; the driver holds
one sum and one centroid for each cluster and component, whatever the input.

A round is one job: blocks and state meet bucket by bucket, without a shuffle,
and the state (12 bytes a vector) is written anew, so a lost executor costs its
tasks of one round.  Distances and sums are exact whole numbers; bounds are
floats with a margin, which costs some needless looks, never a wrong cluster.

Vectors that are null, of another length, or with a null or non-finite
component are left out.  A null vec_id is kept and comes last in the order of
seeds; rows that repeat a vec_id are vectors of their own.  With fewer vectors
than clusters there are as many clusters as vectors; an empty table gives no
rows.  Components beyond 2**27 are reckoned in unbounded integers and always
looked at; a distance or sum that does not fit a long is the largest long.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packets, work

#: Vectors of a block.
BLOCK = 512
#: Whole numbers of one unit.
SCALE = 1024
#: Largest component for which all squares and sums fit 64 bits, and for which they are exact in floats.
SAFE, EXACT = 1 << 27, 1 << 20
#: Relative margin of bounds, above all rounding of floats.
MARGIN = 1e-12
LIMB = 40
LONGEST = (1 << 63) - 1

STATE = "block long, heaps binary, popped long, delta array<struct<cluster:int,component:int,limb:int,value:long>>"
_STATE = pa.schema([("block", pa.int64()), ("heaps", pa.binary()), ("popped", pa.int64()), ("delta", pa.list_(pa.struct([("cluster", pa.int32()), ("component", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])))])


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, or unbounded ones if any is beyond ``SAFE``."""
    if not x.size or np.abs(x).max() * SCALE <= SAFE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = lambda v: int(v) * SCALE if abs(v) >= 1 << 60 else math.floor(v * SCALE)
    out = np.empty(x.shape, object)
    out.reshape(-1)[:] = [exact(v) for v in x.reshape(-1).tolist()]
    return out


def small(*values: np.ndarray, most: int = SAFE) -> bool:
    return all(v.dtype != object and (not v.size or max(-int(v.min()), int(v.max())) <= most) for v in values)


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``q`` to those of ``c``."""
    if small(q, c, most=EXACT):
        x, y = q.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]).astype(np.int64)
    if not small(q, c):
        q, c = q.astype(object), c.astype(object)
    return np.stack([((q - row) ** 2).sum(axis=1) for row in c], axis=1)


def root(n: int) -> float:
    """Square root of a whole number; beyond floats infinity."""
    try:
        return math.sqrt(n)
    except OverflowError:
        return math.inf


def nearest(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number), and a lower bound of its gap to the second nearest."""
    d = distances(q, c)
    best = d.argmin(axis=1).astype(np.int32)
    if len(c) == 1:
        return best, np.full(len(q), np.inf)
    if d.dtype == object:  # always looked at again
        return best, np.full(len(q), -np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return best, two[:, 1] - two[:, 0] - MARGIN * (two[:, 0] + two[:, 1])


class Heaps:
    """The heaps of a block, one for each cluster: lists of (key, row)."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def unpacked(cls, data: bytes) -> Heaps:
        size, key, row = packets.unpack(data)
        cut = np.cumsum(size)[:-1]
        return cls([list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(np.split(key, cut), np.split(row, cut), strict=True)])

    def packed(self) -> bytes:
        """Heap order is kept, so nothing is sorted when they are read again."""
        flat = [x for h in self.heaps for x in h]
        return packets.pack(np.array([len(h) for h in self.heaps], np.int32), np.array([k for k, _ in flat], np.float64), np.array([r for _, r in flat], np.int32))

    def expired(self, drift: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Rows popped because their key is not above their cluster's drift, and the clusters that they leave."""
        rows, left = [], []
        for c, (heap, limit) in enumerate(zip(self.heaps, drift, strict=True)):
            limit += MARGIN * (1 + limit)
            while heap and heap[0][0] <= limit:
                rows.append(heapq.heappop(heap)[1])
                left.append(c)
        return np.array(rows, np.int64), np.array(left, np.int32)

    def push(self, rows: np.ndarray, clusters: np.ndarray, gaps: np.ndarray, drift: list[float]) -> None:
        keys = gaps + np.array(drift)[clusters]
        for r, c, k in zip(rows.tolist(), clusters.tolist(), keys.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (k, r))

    def clusters(self) -> np.ndarray:
        """The cluster of each row of the block."""
        out = np.zeros(sum(map(len, self.heaps)), np.int32)
        for c, heap in enumerate(self.heaps):
            out[[r for _, r in heap]] = c
        return out


def limbs(value: int) -> list[tuple[int, int]]:
    """A whole number as (limb, value) of ``LIMB`` bits, all of its sign."""
    out, sign, value, k = [], -1 if value < 0 else 1, abs(value), 0
    while value:
        if part := value & ((1 << LIMB) - 1):
            out.append((k, sign * part))
        value >>= LIMB
        k += 1
    return out


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and x (doubles) of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    whole_ = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).filter(whole_).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt and vec_id (ties by components): k rows for the driver."""
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(name.asc_nulls_last(), "x").limit(k).collect()
    return whole(np.array([r["x"] for r in first], np.float64))


def in_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """block, ids, width and data: matrices of 16 or 32-bit integers, or of the doubles themselves (width 8)."""

    def pack(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for a in range(0, len(x), BLOCK):
                part = x[a : a + BLOCK]
                q = whole(part)
                kind = next((t for t in ("<i2", "<i4") if small(q, most=np.iinfo(t).max if t == "<i2" else SAFE)), "<f8")
                data = (part if kind == "<f8" else q).astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([b.column("vec_id").slice(a, BLOCK).to_pylist()], pa.list_(pa.int64())), pa.array([int(kind[2])], pa.int32()), pa.array([data], pa.binary())], names=["block", "ids", "width", "data"])
                n += 1

    return rows.mapInArrow(pack, "block long, ids array<long>, width int, data binary")


def matrix(width: int, data: bytes, dims: int) -> np.ndarray:
    if width == 8:
        return whole(np.frombuffer(data, "<f8").reshape(-1, dims))
    return np.frombuffer(data, f"<i{width}").reshape(-1, dims).astype(np.int64)


def _round(c: np.ndarray, drift: list[float]):
    """A task of a round: pops what has expired, or takes all rows where there is no state yet; its last row has the change of sums."""

    def run(batches):
        k, dims = c.shape
        change, last = np.zeros((k, dims + 1), object), None
        for b in batches:
            for block, width, data, state in zip(*(b.column(n).to_pylist() for n in ("block", "width", "data", "heaps")), strict=True):
                q = matrix(width, data, dims)
                if state is None:
                    heaps, rows, left = Heaps([[] for _ in range(k)]), np.arange(len(q)), None
                else:
                    heaps = Heaps.unpacked(state)
                    rows, left = heaps.expired(drift)
                if len(rows):
                    to, gap = nearest(q[rows], c)
                    heaps.push(rows, to, gap, drift)
                    moved = np.arange(len(rows)) if left is None else np.flatnonzero(left != to)
                    one = np.concatenate([q[rows[moved]], np.ones((len(moved), 1), q.dtype)], axis=1)
                    for a in range(k):
                        change[a] += one[to[moved] == a].sum(axis=0)
                        if left is not None:
                            change[a] -= one[left[moved] == a].sum(axis=0)
                    state = heaps.packed()
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, _STATE, strict=True)], schema=_STATE)
                last = (block, state, len(rows), None)
        if last:
            delta = [{"cluster": a, "component": j, "limb": i, "value": v} for a in range(k) for j in range(dims + 1) for i, v in limbs(int(change[a, j]))]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*last[:3], delta), _STATE, strict=True)], schema=_STATE)

    return run


def _add(sums: np.ndarray, state: DataFrame) -> int:
    """Add the changes of a round to the sums (k rows of components and count); the number of vectors looked at."""
    each = state.select(F.explode("delta").alias("d")).select("d.*").groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("v"))
    for r in each.collect():  # one for each cluster, component and limb
        sums[r["cluster"], r["component"]] += int(r["v"]) << (LIMB * r["limb"])
    return state.agg(F.sum("popped")).head()[0] or 0


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3:") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(rows, centroids, looks): vec_id, cluster and distance (squared) of every vector kept, the final centroids, and how many vectors each round looked at.

    ``vectors`` has vec_id and embedding.
    """
    spark = vectors.sparkSession
    work.small_batches(spark)
    scratch = work.Scratch(spark)
    rows = kept(vectors, dims)
    c = seeds(rows, k, salt)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), c, []
    k = len(c)
    blocks = scratch.written(in_blocks(rows, dims).repartition(work.buckets(vectors), "block"), "vectors", "block")
    sums, drift, looks, state = np.zeros((k, dims + 1), object), [0.0] * k, [], None
    for at in range(rounds + 1):
        # buckets of both tables meet where they lie
        with_state = blocks.withColumn("heaps", F.lit(None).cast("binary")) if state is None else blocks.join(state.select("block", "heaps").hint("shuffle_hash"), "block")
        after = scratch.written(with_state.select("block", "width", "data", "heaps").mapInArrow(_round(c, drift), STATE), "state", "block")
        scratch.keep(blocks, after)
        state = after
        looks.append(_add(sums, state))
        if at == rounds:
            break
        new = np.array([[int(s) // int(n) for s in row] if (n := row_n) else old for row, row_n, old in zip(sums[:, :dims].tolist(), sums[:, dims].tolist(), c.tolist(), strict=True)], object)
        moved = [root(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) * (1 + MARGIN) for a, b in zip(new.tolist(), c.tolist(), strict=True)]
        if not any(moved):
            break
        # what a cluster's vectors can lose: their own centroid's way and the longest of the others
        drift = [d + m + max([0.0, *moved[:a], *moved[a + 1 :]]) for a, (d, m) in enumerate(zip(drift, moved, strict=True))]
        c = new.astype(np.int64) if max(abs(v) for v in new.reshape(-1).tolist()) <= SAFE else new

    def own(batches):
        for b in batches:
            for ids, width, data, heaps in zip(*(b.column(n) for n in ("ids", "width", "data", "heaps")), strict=True):
                q, to = matrix(width.as_py(), data.as_py(), dims), Heaps.unpacked(heaps.as_py()).clusters()
                d = np.zeros(len(q), np.int64)
                for a in range(k):
                    mine = np.flatnonzero(to == a)
                    if len(mine):
                        d[mine] = np.minimum(distances(q[mine], c[a : a + 1])[:, 0], LONGEST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(to, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    out = blocks.join(state.select("block", "heaps").hint("shuffle_hash"), "block").select("ids", "width", "data", "heaps").mapInArrow(own, "vec_id long, cluster int, distance long")
    out = scratch.written(out, "assigned")
    scratch.keep(out)
    return out, c, looks


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; one row a cluster is joined."""
    total = F.least(F.sum(F.col("distance").cast("decimal(20,0)")), F.lit(LONGEST)).cast("long")
    named = [(a, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for a, row in enumerate(centroids.tolist())]
    names = rows.sparkSession.createDataFrame(named, "cluster int, centroid_sha256 string")
    per = rows.groupBy("cluster").agg(total.alias("cluster_inertia")).join(F.broadcast(rows.agg(total.alias("inertia")))).join(F.broadcast(names), "cluster")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all ``embeddings`` after ten rounds."""
    rows, centroids, _ = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return with_inertia(rows, centroids)
