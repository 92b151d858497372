"""An inverted-file index of vectors: cells around centroids, stored as partitions, of which a search reads a few.

Centroids are fitted on a bounded sample (the ``SAMPLE`` rows with the least
hash of their id); every row is then put into the cell of its nearest centroid.
How many cells a search should probe is measured on the sample as well: as many
as find ``RECALL`` of the ten nearest rows of some of its own rows.
``cells`` holds each centroid with the widest angle between it and a row of its
cell, so a cell tells how similar its rows can be to a query at most.  A search
probes the nearest cells of each query.  With ``exact`` it goes on with those
cells whose bound reaches the k-th similarity found so far, and gives what
comparing all rows would give.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.vectors import QUERY_BLOCK, ROW_BLOCK, best, best_of_blocks, unit_rows

#: Rows that centroids are fitted on, in one task.
SAMPLE = 20_000
ROUNDS = 12
#: Share of the nearest rows that a search should find, rows of the sample that it is measured on, and how many neighbours of each.
RECALL, MEASURED, NEIGHBOURS = 0.95, 256, 10
#: Rows of a cell that are written by one task.
CELL_ROWS = 1 << 18
#: What roundings of cosines and angles may amount to.
SLACK = 2e-6
CELLS = "cell int, part int, n long, angle double, centroid array<double>, probes int"
BLOCKS = "ids binary, data binary, part int, cell int"


def fitted(sample: DataFrame, cells: int) -> DataFrame:
    """cell, centroid, and probes, the same in each row: spherical k-means of a bounded sample, in one task."""

    def fit(batches):
        m = [unit_rows(b.column("embedding"))[0] for b in batches]
        m = np.concatenate([x for x in m if len(x)] or [np.zeros((0, 1))])
        k = min(cells, len(m))
        if not k:
            return
        rng = np.random.default_rng(0)
        c = m[rng.choice(len(m), k, replace=False)]
        for _ in range(ROUNDS):
            own = (m @ c.T).argmax(axis=1)
            order = np.argsort(own, kind="stable")
            first = np.searchsorted(own[order], np.arange(k))
            there = np.flatnonzero(np.bincount(own, minlength=k))
            c[there] = np.add.reduceat(m[order], first[there], axis=0)
            c /= np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-12)[:, None]
        asked = m[:MEASURED]
        near = np.argsort(-(asked @ m.T), axis=1)[:, :NEIGHBOURS]
        # which of its nearest cells a neighbour's cell is
        place = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)[np.arange(len(asked))[:, None], (m @ c.T).argmax(axis=1)[near]]
        found = np.cumsum(np.bincount(place.reshape(-1), minlength=k)) / place.size
        probes = int(np.searchsorted(found, RECALL)) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(c.tolist(), pa.list_(pa.float64())), pa.array(np.full(k, probes, np.int32))], names=["cell", "centroid", "probes"])

    return sample.coalesce(1).mapInArrow(fit, "cell int, centroid array<double>, probes int")


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int = 64) -> VectorIndex:
        """A new index of ``rows`` (vec_id, embedding); null and zero vectors are left out."""
        index = cls(rows.sparkSession, path)
        sample = rows.filter("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding")
        made = fitted(sample, cells).orderBy("cell").collect()  # ``cells`` rows
        index._put(rows, np.array([r["centroid"] for r in made], np.float64), 0, made[0]["probes"] if made else 0)
        return index

    def add(self, rows: DataFrame) -> None:
        """More rows, put into the cells that there are; they must be new."""
        have = self._cells()
        self._put(rows, self._centroids(have), 1 + max([r["part"] for r in have], default=0), have[0]["probes"] if have else 0)

    def _cells(self) -> list:
        return self.spark.read.schema(CELLS).parquet(f"{self.path}/cells").collect()  # one row for each cell and addition

    @staticmethod
    def _centroids(have: list) -> np.ndarray:
        return np.array([r["centroid"] for r in sorted(have, key=lambda r: r["cell"]) if r["part"] == 0], np.float64)

    def _put(self, rows: DataFrame, centroids: np.ndarray, part: int, probes: int) -> None:
        def assign(batches):
            for b in batches:
                m, there = unit_rows(b.column("embedding"))
                if not len(there):
                    continue
                s = m @ centroids.T
                own = s.argmax(axis=1)
                angle = np.arccos(np.clip(s[np.arange(len(m)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(there)), pa.array(m.tolist(), pa.list_(pa.float64())), pa.array(own.astype(np.int32)), pa.array(angle)], names=["vec_id", "x", "cell", "angle"])

        def pack(batches):
            for b in batches:
                cell, ids = b.column("cell").to_numpy(), b.column("vec_id").to_numpy().astype(np.int64)
                m = b.column("x").flatten().to_numpy().reshape(len(ids), -1)
                for first in np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist() if len(cell) else []:
                    end = first + int(np.searchsorted(cell[first:], cell[first], "right"))
                    for a in range(first, end, ROW_BLOCK):
                        z = min(a + ROW_BLOCK, end)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[a:z].tobytes()], pa.binary()), pa.array([m[a:z].tobytes()], pa.binary()), pa.array([cell[first]], pa.int32())], names=["ids", "data", "cell"])

        placed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("embedding is not null").mapInArrow(assign, "vec_id long, x array<double>, cell int, angle double") if len(centroids) else self.spark.createDataFrame([], "vec_id long, x array<double>, cell int, angle double")
        per = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"))
        names = self.spark.createDataFrame([(k, c) for k, c in enumerate(centroids.tolist())], "cell int, centroid array<double>")
        cells = names.join(per, "cell", "left").select("cell", F.lit(part).alias("part"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("angle", F.lit(0.0)).alias("angle"), "centroid", F.lit(probes).alias("probes"))
        cells.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/staged/part={part}")
        # a cell of many rows is written by several tasks
        tasks = self.spark.read.parquet(f"{self.path}/staged/part={part}").select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("tasks"))
        dealt = placed.join(tasks, "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.greatest("tasks", F.lit(1))))
        packed = dealt.repartition("cell", "salt").sortWithinPartitions("cell").select("vec_id", "x", "cell").mapInArrow(pack, "ids binary, data binary, cell int")
        packed.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/blocks/part={part}")
        # the cells come last: without them an addition does not count
        self.spark.read.schema(CELLS.replace("part int, ", "")).parquet(f"{self.path}/staged/part={part}").withColumn("part", F.lit(part)).coalesce(1).write.mode("append" if part else "overwrite").parquet(f"{self.path}/cells")

    def _probes(self, queries: DataFrame, choose, extra: str = "") -> DataFrame:
        """Blocks of queries (qi, qv) for each cell that ``choose`` names: it gets unit vectors and the batch, and gives pairs (row, cell)."""

        def probe(batches):
            for b in batches:
                m, there = unit_rows(b.column("embedding"))
                row, cell = choose(m, b.take(pa.array(there))) if len(there) else (there, there)
                ids = b.column("query_id").to_numpy().astype(np.int64)[there][row]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(ids), pa.array([x.tobytes() for x in m[row]], pa.binary())], names=["cell", "query_id", "q"])

        def pack(batches):
            for b in batches:
                cell, ids, q = b.column("cell").to_numpy(), b.column("query_id").to_numpy(), b.column("q").to_pylist()
                for first in np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist() if len(cell) else []:
                    end = first + int(np.searchsorted(cell[first:], cell[first], "right"))
                    for a in range(first, end, QUERY_BLOCK):
                        z = min(a + QUERY_BLOCK, end)
                        yield pa.RecordBatch.from_arrays([pa.array([cell[first]], pa.int32()), pa.array([ids[a:z].tobytes()], pa.binary()), pa.array([b"".join(q[a:z])], pa.binary())], names=["cell", "qi", "qv"])

        asked = queries.mapInArrow(probe, "cell int, query_id long, q binary")
        return asked.repartition("cell").sortWithinPartitions("cell").mapInArrow(pack, "cell int, qi binary, qv binary")

    def _found(self, probes: DataFrame, parts: list[int], k: int) -> DataFrame:
        # only the partitions of the cells that some query probes are read
        cells = [r["cell"] for r in probes.select("cell").distinct().collect()]  # no more than there are cells
        blocks = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks").filter(F.col("part").isin(parts) & F.col("cell").isin(cells))
        return best_of_blocks(blocks.withColumnsRenamed({"ids": "ri", "data": "rv"}).join(probes, "cell"), k)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, vec_id, similarity (six places) and rank of the k nearest rows of each query (query_id, embedding) among the cells probed (by default as many as were measured), or, with ``exact``, among all."""
        have = self._cells()
        centroids, parts = self._centroids(have), sorted({r["part"] for r in have})
        if not len(centroids):
            return self.spark.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")
        angle = np.zeros(len(centroids))
        for r in have:
            angle[r["cell"]] = max(angle[r["cell"]], r["angle"])
        count = min(probes or have[0]["probes"], len(centroids))

        def nearest(m: np.ndarray) -> np.ndarray:
            return np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :count]

        def first(m, _):
            return np.repeat(np.arange(len(m)), count), nearest(m).reshape(-1)

        queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
        found = best(self._found(self._probes(queries, first), parts, k), k)
        if not exact:
            return found

        def rest(m, batch):
            reached = batch.column("reached").to_numpy(zero_copy_only=False)
            away = np.arccos(np.clip(m @ centroids.T, -1, 1)) - angle[None, :]
            bound = np.cos(np.clip(away, 0, np.pi)) + SLACK
            ok = bound >= np.where(np.isnan(reached), -2.0, reached)[:, None]
            np.put_along_axis(ok, nearest(m), False, axis=1)
            return np.nonzero(ok)

        kth = found.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("reached"))
        again = self._probes(queries.join(kth, "query_id", "left"), rest)
        return best(found.drop("rank").unionByName(self._found(again, parts, k)), k)
