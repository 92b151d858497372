"""Exact vector search for many queries: blocks of queries meet blocks of vectors in one matrix product each."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
QUERY_BLOCK, ROW_BLOCK = 512, 4096
#: Most bytes of query blocks that are broadcast.
BROADCAST_BYTES = 64 << 20


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the unit vectors of a list column, and which of its rows they are; null and zero vectors are left out."""
    there = np.flatnonzero(~np.asarray(column.is_null()))
    m = column.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = m.reshape(len(there), -1) if len(there) else np.zeros((0, 1))
    norm = np.sqrt((m * m).sum(axis=1))
    return m[norm > 0] / norm[norm > 0, None], there[norm > 0]


def _blocks(df: DataFrame, key: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Rows packed into blocks: ids and vectors as binary columns; null and zero vectors are left out."""

    def pack(batches):
        for b in batches:
            m, there = unit_rows(b.column(1))
            ids = b.column(0).to_numpy()[there].astype(np.int64)
            for a in range(0, len(ids), size):
                yield pa.RecordBatch.from_arrays([pa.array([ids[a : a + size].tobytes()], pa.binary()), pa.array([m[a : a + size].tobytes()], pa.binary())], names=list(names))

    return df.select(key, vector).mapInArrow(pack, f"{names[0]} binary, {names[1]} binary")


def best_of_blocks(pairs: DataFrame, k: int, floor: float | None = None, rescaled: bool = False) -> DataFrame:
    """query_id, vec_id and similarity (six places): of each pair of blocks (qi, qv, ri, rv) the k best rows of every query."""

    def score(batches):
        for b in batches:
            for qi, qv, ri, rv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q, r = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                s = np.frombuffer(qv).reshape(len(q), -1) @ np.frombuffer(rv).reshape(len(r), -1).T
                s = np.round((1 + s) / 2 if rescaled else s, 6)
                out = ([], [], [])
                for i in range(len(q)):
                    near = np.lexsort((r, -s[i]))[:k]
                    near = near[s[i][near] >= floor] if floor is not None else near
                    out[0].append(np.full(len(near), q[i]))
                    out[1].append(r[near])
                    out[2].append(s[i][near])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "similarity"])

    return pairs.select("qi", "qv", "ri", "rv").mapInArrow(score, "query_id long, vec_id long, similarity double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k most similar rows of each query, ties by vec_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine_top(queries: DataFrame, rows: DataFrame, k: int, floor: float | None = None, rescaled: bool = False) -> DataFrame:
    """query_id, vec_id, similarity (six places) and rank of each query's k nearest rows, ties by vec_id.

    floor: least similarity; rescaled: (1 + cosine) / 2.  Each pair of blocks
    keeps its k best, so what is shuffled grows with queries and blocks only.
    """
    left = _blocks(queries, "query_id", "embedding", QUERY_BLOCK, ("qi", "qv"))
    right = _blocks(rows, "vec_id", "embedding", ROW_BLOCK, ("ri", "rv"))
    # query blocks go to all tasks while they are small; beyond that Spark pairs the blocks
    size = left.agg(F.sum(F.length("qv") + F.length("qi"))).head()[0] or 0
    pairs = right.crossJoin(F.broadcast(left) if size <= BROADCAST_BYTES else left)
    return best(best_of_blocks(pairs, k, floor, rescaled), k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in a row; 0.0 where one is zero, null where one is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).when(norms == 0, 0.0)


def hash_embedding(df: DataFrame, text: str, dims: int = 64) -> DataFrame:
    """Adds ``embedding``: a deterministic stand-in for a model, signed counts of word hashes, L2-normed; blank text gives null."""
    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            words = (t or "").lower().split()
            if not words:
                out.append(None)
                continue
            h = np.array([zlib.crc32(w.encode()) for w in words])
            v = np.bincount(h % dims, np.where((h >> 16) & 1, 1.0, -1.0), dims)
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return df.withColumn("embedding", embed(text))


def backfill(df: DataFrame, text: str, old: str, new: str, embed=hash_embedding) -> DataFrame:
    """Rows that have the ``old`` vector but lack the ``new`` one get it from their text; all others stay as they are."""
    todo = F.col(old).isNotNull() & F.col(new).isNull()
    # the text of other rows is null, so nothing is computed for them
    made = embed(df.select(F.struct("*").alias("row"), todo.alias("todo"), F.when(todo, F.col(text)).alias("text")), "text")
    return made.select(*[F.when(F.col("todo"), F.col("embedding")).otherwise(F.col("row")[c]).alias(c) if c == new else F.col("row")[c].alias(c) for c in df.columns])
