"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a few statistics of its bytes, words and lines.  Random
Fourier features of the standardised statistics approximate a Gaussian kernel;
the ridge solution comes from normal equations, which every partition sums up
for its labelled rows; isotonic regression over bins of the raw score turns it
into a chance.  Only labels of the training fold are read, and only the text is
an input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, work

FEATURES = 192
RIDGE = 1.0
SEED = 7
BINS = 2000
THRESHOLD = 0.3
#: Partial sums that come to the driver: a fixed number, whatever the partitions.
SUMS = 16


def _kinds() -> list[np.ndarray]:
    """Kinds of bytes, as tables of 256 flags."""
    b = np.arange(256)
    text = lambda s: np.isin(b, list(s.encode()))
    return [(b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), text("#*$%&|<>"), text(".?"), text(",;:"), text("!"), b >= 128, b == 10, blocks.SPACES.copy(), text("@/_=+~^{}[]()\\\"'`-")]


KINDS = _kinds()
#: Statistics of a text: see statistics().
N_STATS = len(KINDS) + 12


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often its most frequent one occurs."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    of = (key[new] >> np.uint64(40)).astype(np.int64)
    often = np.zeros(rows, np.int64)
    np.maximum.at(often, of, np.diff(np.r_[new, len(key)]))
    return np.bincount(of, minlength=rows), often


def statistics(s: blocks.Slice) -> np.ndarray:
    """One row of ``N_STATS`` floats for each text; an empty text has zeros where shares are not defined."""
    rows, off = len(s.off) - 1, s.off
    size = np.diff(off)
    start, end, first = blocks.words(s.buf, off)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    length = end - start
    h = blocks.mix(blocks.spans_hash(blocks.prefix_hashes(s.buf), start, end) + length.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    one = np.maximum(n, 1)
    chars = np.maximum(size, 1)
    out = [per_row(k[s.buf], off) / chars for k in KINDS]
    total = np.bincount(row, length, rows)
    mean = total / one
    square = np.bincount(row, length.astype(float) ** 2, rows) / one
    symbol = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum(KINDS[3][s.buf] | KINDS[6][s.buf], out=symbol[1:])
    marked = np.bincount(row, symbol[end] > symbol[start], rows) / one if len(start) else np.zeros(rows)
    words, often = distinct(row, h, rows)
    inside = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    same = np.bincount(row[inside], h[inside] == h[inside + 1], rows) / one if len(inside) else np.zeros(rows)
    pairs, pair_often = distinct(row[inside], blocks.mix(h[inside] + h[inside + 1] * np.uint64(3)), rows) if len(inside) else (np.zeros(rows), np.zeros(rows))
    lines = per_row(KINDS[8][s.buf], off) + 1
    out += [np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(square - mean**2, 0)), marked, words / one, np.log1p(words) / np.log1p(one), often / one, same, pairs / one, pair_often / one, np.log(lines / one + 1)]
    return np.stack(out, axis=1).astype(np.float64)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every text (null: empty)."""

    def run(batches):
        for s in blocks.slices(batches):
            x = statistics(s)
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_STATS, pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([s.rows.column("doc_id"), flat], names=["doc_id", "stats"])

    return work.texts(docs).mapInArrow(run, "doc_id long, stats array<double>")


def stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS)


class Model:
    """What the driver holds: scales, the random directions, weights and the calibration curve."""

    def __init__(self, mean, scale, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.array(mean), np.array(scale)
        self.directions = rng.normal(size=(N_STATS, FEATURES)) / np.sqrt(N_STATS)
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + N_STATS + 1)
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.directions + self.phases) * np.sqrt(2), z, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.curve), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: the knots of a rising curve."""
    blocks_: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks_.append([a * c, b, c])
        while len(blocks_) > 1 and blocks_[-2][1] / blocks_[-2][2] >= blocks_[-1][1] / blocks_[-1][2]:
            last = blocks_.pop()
            blocks_[-1] = [p + q for p, q in zip(blocks_[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks_]), np.array([b[1] / b[2] for b in blocks_])


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a positive definite system by elimination, in plain sums: a BLAS with threads may hang beside a running session."""
    a, b = a.copy(), b.copy()
    for k in range(len(b) - 1):
        part = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] -= part[:, None] * a[k, k + 1 :]
        b[k + 1 :] -= part * b[k]
    for k in range(len(b) - 1, -1, -1):
        b[k] = (b[k] - (a[k, k + 1 :] * b[k + 1 :]).sum()) / a[k, k]
    return b


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fits to the rows of ``stats`` that ``labels`` (doc_id, quality 0 or 1) has; without any, every score is 0.5."""
    scale = stats.agg(*[F.struct(F.avg(F.col("stats")[k]).alias("m"), F.stddev_pop(F.col("stats")[k]).alias("s")).alias(f"c{k}") for k in range(N_STATS)]).head()
    model = Model([c["m"] or 0.0 for c in scale], [max(c["s"] or 0.0, 1e-6) for c in scale])
    train = stats.join(labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id")
    width = len(model.weights)

    def sums(batches):
        a, b = np.zeros((width, width)), np.zeros(width)
        for x in batches:
            f = model.features(stack(x.column("stats"))) if x.num_rows else np.zeros((0, width))
            a += f.T @ f
            b += f.T @ x.column("quality").to_numpy()
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task % SUMS], pa.int32()), blocks.binary_column([np.r_[a.reshape(-1), b].tobytes()])], names=["slot", "sums"])

    def add(batches):
        by: dict[int, np.ndarray] = {}
        for x in batches:
            for slot, raw in zip(x.column("slot").to_pylist(), x.column("sums").to_pylist(), strict=True):
                v = np.frombuffer(raw)
                by[slot] = by[slot] + v if slot in by else v
        if by:
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), blocks.binary_column([v.tobytes() for v in by.values()])], names=["slot", "sums"])

    schema = "slot int, sums binary"
    total = sum((np.frombuffer(r["sums"]) for r in train.mapInArrow(sums, schema).repartition(SUMS, "slot").mapInArrow(add, schema).collect()), np.zeros(width * width + width))
    a, b = total[: width * width].reshape(width, width), total[width * width :]
    model.weights = solved(a + RIDGE * np.eye(width), b)

    def raw(batches):
        for x in batches:
            r = model.raw(stack(x.column("stats"))) if x.num_rows else np.zeros(0)
            bins = np.clip((r + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), x.column("quality")], names=["bin", "quality"])

    bins = train.mapInArrow(raw, "bin int, quality double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("y")).orderBy("bin").collect()
    if bins:
        x, y = isotonic(np.array([(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in bins]), np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))
        model.curve = (x, y)
    else:
        model.curve = (np.array([0.0]), np.array([0.5]))
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""

    def run(batches):
        for x in batches:
            s = model.score(stack(x.column("stats"))) if x.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all ``documents``; four fifths of ``labels`` are for training."""
    stats = work.written(with_statistics(work.read_documents(spark, sf_dir)), "stats")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    out = scored(stats, fit(stats, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
