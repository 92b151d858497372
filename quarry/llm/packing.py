"""Packing documents into sequences of a fixed number of tokens.

A document longer than a sequence is cut into whole sequences and a rest.  The
rests are a cutting-stock problem: their lengths, in classes of ``UNIT``
tokens, form a histogram of at most ``CLASSES`` bars whatever the corpus; a
linear program over patterns (how many rests of each class share a sequence)
is solved by column generation, a knapsack dynamic program pricing the
columns.  Patterns are rounded down, what is left is filled by first fit
decreasing, and the k-th rest of a class takes the k-th place that the patterns
hold for that class.  Ranks come from counts by task, so no class is gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks, tokens, work

SEQUENCE = 2048
UNIT = 8
CLASSES = SEQUENCE // UNIT
#: Class of pieces that fill a sequence by themselves.
FULL = CLASSES + 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, task int, local long"


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """Counts of the items that fill ``room`` with most value (sizes ascending)."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = int(np.searchsorted(size, w, "right"))
        if fits:
            gain = best[w - size[:fits]] + value[:fits]
            k = int(np.argmax(gain))
            best[w], took[w] = gain[k], k
        if best[w - 1] > best[w]:
            best[w], took[w] = best[w - 1], -2
    out, w = np.zeros(len(size)), room
    while w > 0 and took[w] != -1:
        if took[w] == -2:
            w -= 1
        else:
            out[took[w]] += 1
            w -= size[took[w]]
    return out


def product(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (a * v).sum(axis=1)


def pivoted(inverse: np.ndarray, column: np.ndarray, k: int) -> np.ndarray:
    """The inverse of a basis whose k-th column gives way to ``column``."""
    step = product(inverse, column)
    pivot = inverse[k] / step[k]
    out = inverse - step[:, None] * pivot
    out[k] = pivot
    return out


def cutting_stock(demand: dict[int, int], room: int = CLASSES, gap: float = 2e-3, rounds: int = 1500) -> list[tuple[dict[int, int], int]]:
    """Patterns (class: places) and how many sequences follow each; places of a class add up to its demand."""
    size = np.array(sorted(k for k, v in demand.items() if v > 0), int)
    if not len(size):
        return []
    need = np.array([demand[int(k)] for k in size], float)
    # first fit decreasing in fractions: each pattern uses up one class, so the patterns are a basis
    # (their inverse is kept by pivots in plain sums: a BLAS with threads may hang beside a running session)
    columns, x, open_ = np.diag((room // size).astype(float)), np.zeros(len(size)), need.copy()
    inverse = np.diag(1 / np.diag(columns))
    while (open_ > 1e-9).any():
        free, pattern = room, np.zeros(len(size))
        for k in np.flatnonzero(open_ > 1e-9)[::-1]:
            pattern[k] = free // size[k]
            free -= int(pattern[k]) * size[k]
        ratio = np.where(pattern > 0, open_ / np.maximum(pattern, 1), np.inf)
        k = int(np.argmin(ratio))
        columns[:, k], x[k] = pattern, ratio[k]
        inverse = pivoted(inverse, pattern, k)
        open_ -= ratio[k] * pattern
        open_[k] = 0.0
    # prices are drawn towards those that gave the best bound, volumes at first, or they would swing
    center, bound = size / room, 0.0
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        for pull in (0.8, 0.4, 0.0):
            mixed = np.maximum(pull * center + (1 - pull) * price, 0)
            column = knapsack(mixed, size, room)
            at_least = float((mixed * need).sum()) / max(1.0, float((mixed * column).sum()))
            if at_least > bound:
                bound, center = at_least, mixed
            if float((price * column).sum()) > 1 + 1e-7:
                break
        else:
            break
        if x.sum() <= bound * (1 + gap):
            break
        step = product(inverse, column)
        able = step > 1e-9
        ratio = np.full(len(x), np.inf)
        ratio[able] = x[able] / step[able]
        leave = int(np.argmin(ratio))
        x = x - ratio[leave] * step
        x[leave] = ratio[leave]
        inverse = pivoted(inverse, column, leave)
        columns[:, leave] = column
    whole = np.floor(np.maximum(x, 0) + 1e-7).astype(int)
    # rounding noise must not hand out more places than there are rests
    over = product(columns, whole) - need > 0.5
    while over.any():
        k = next(k for k in range(len(whole)) if whole[k] and (columns[over, k] > 0).any())
        whole[k] -= 1
        over = product(columns, whole) - need > 0.5
    out = [({int(s): int(c) for s, c in zip(size, columns[:, k], strict=True) if c}, int(whole[k])) for k in range(len(whole)) if whole[k]]
    left = np.rint(need - product(columns, whole)).astype(int)
    while left.any():  # at most a few thousand rests, however large the corpus
        free, pattern = room, {}
        for k in range(len(size) - 1, -1, -1):
            if n := min(int(left[k]), free // int(size[k])):
                pattern[int(size[k])] = n
                free -= n * int(size[k])
        times = min(int(left[np.flatnonzero(size == s)[0]]) // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[np.flatnonzero(size == s)[0]] -= n * times
        out.append((pattern, times))
    return out


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, spaced: bool) -> DataFrame:
    """The pieces of every document (null text: empty), each with its class and its rank in class and task."""

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(FULL + 1, np.int64)
        encoder = tokens.WordEncoder.of(vocabulary, spaced)
        for s in blocks.slices(batches):
            ids = s.column("doc_id")
            rows = []
            flat, counts = encoder.encode_rows(s.buf, s.off, end_id)
            flat, end = flat.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            for i, n in enumerate(counts.tolist()):
                raw = flat[end[i] - 4 * n : end[i]]
                for a in range(0, n, SEQUENCE):
                    length = min(SEQUENCE, n - a)
                    cls = FULL if length == SEQUENCE else -(-length // UNIT)
                    rows.append((int(ids[i]), a, length, tokens.crc(raw[4 * a : 4 * (a + length)]), n, cls, task, int(seen[cls])))
                    seen[cls] += 1
            kinds = (pa.int64(),) * 5 + (pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
        encoder.release()

    return work.texts(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int, spaced: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document has its end id, so an empty or null text is a piece of one
    id.  Repeated rows are packed each for itself; an empty table gives no rows.
    """
    pieces = work.written(token_pieces(docs, vocabulary, end_id, spaced), "pieces")
    counts = pieces.groupBy("cls", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("cls").orderBy("task")
    first = counts.select("cls", "task", (F.sum("n").over(earlier) - F.col("n")).alias("first"))
    histogram = {int(r["cls"]): int(r["n"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # at most CLASSES + 1 rows
    full = histogram.pop(FULL, 0)
    patterns = cutting_stock(histogram)
    # for each class: how many of its rests the patterns before hold, places a sequence, first sequence
    plan: dict[int, list[tuple[int, int, int]]] = {FULL: [(0, 1, 0)]}
    sequence, held = full, dict.fromkeys(histogram, 0)
    for pattern, times in patterns:
        for cls, n in pattern.items():
            plan.setdefault(cls, []).append((held[cls], n, sequence))
            held[cls] += n * times
        sequence += times
    table = {cls: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for cls, rows in plan.items()}

    def place(batches):
        for b in batches:
            cls = b.column("cls").to_numpy()
            rank = b.column("rank").to_numpy()
            sequence_id, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for k in np.unique(cls):
                m = cls == k
                before, places, at = table[int(k)]
                p = np.searchsorted(before, rank[m], "right") - 1
                inside = rank[m] - before[p]
                sequence_id[m], slot[m] = at[p] + inside // places[p], inside % places[p]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence_id), pa.array(slot)], names=[*b.schema.names, "sequence_id", "slot"])

    ranked = pieces.join(first, ["cls", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", (F.col("first") + F.col("local")).alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, rank long, sequence_id long, slot long")
    own = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "slot")
    return placed.withColumn("offset", F.sum("length").over(own) - F.col("length")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all ``documents`` with the lower-case word vocabulary and end id 1."""
    return pack(work.read_documents(spark, sf_dir), tokens.vocabulary("word_bpe_49k.json"), 1)
