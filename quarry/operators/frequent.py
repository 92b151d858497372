"""The most frequent n-grams of a corpus in two passes: mergeable summaries name candidates, and only these are counted.

Words become 64-bit hashes within the JVM, and n-grams are hashed from them in
arrays.  In the first pass each task keeps a summary of its n-grams: counters
that, when there are more than ``HELD`` of them, all lose the count of the
first one beyond (and those that reach nothing go).  What was lost is the
task's error; summaries add up, and so do errors.  So every n-gram that occurs
more often than the summed error has a counter, and its count is short by that
error at most.  The second pass counts exactly the n-grams whose counter can
reach the place that is asked for, and the answer stands if its last place lies
above what a candidate must have had; if not, more candidates are taken, and in
the end all n-grams are counted.

N-grams are told apart by 64 bits (of ten million different ones, two are alike
with a chance of 3 in a million).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.keyword import grams

#: Counters that a task holds, and those that it passes on.
HELD, SENT = 1 << 20, 1 << 16
#: N-grams gathered before they are merged into the summary.
GATHERED = 1 << 22
#: Most candidates that the second pass looks for; beyond it all n-grams are counted.
MOST_CANDIDATES = 1 << 22
U = np.uint64


def hashed_words(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """key and w, the hashes of the words that count, and further columns."""
    return df.select(F.col(key).cast("long").alias("key"), F.transform(grams(F.col(text)), lambda x: F.xxhash64(x)).alias("w"), *more)


def gram_hashes(w: np.ndarray, row: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of the runs of k words within a row, for k up to ``most``."""
    w = w.view(U)
    h = w * U(0x9E3779B97F4A7C15) ^ (w >> U(32))
    at = np.arange(len(w))
    for k in range(1, most + 1):
        if k > 1:
            # a run of k words is one of k - 1 and the word after it
            h = h[:-1] * U(0xC2B2AE3D27D4EB4F) ^ (h[:-1] >> U(29)) ^ (w[k - 1 :] * U(0x165667B19E3779F9))
            same = row[: len(h)] == row[k - 1 :]
            yield k, at[: len(h)][same], h[same]
        else:
            yield k, at, h
        if len(h) < 2:
            return


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    size = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(size)), size)


class Summary:
    """Counters of the most frequent keys of a stream; ``error`` is what any count may be short of."""

    def __init__(self, held: int):
        self.held, self.error = held, 0
        self.key, self.count = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, key: np.ndarray) -> None:
        fresh = Summary(self.held)
        fresh.key, fresh.count = np.unique(key, return_counts=True)
        fresh.cut(self.held)  # keys that occur but once mostly go here
        self.error += fresh.error
        key, count = np.r_[self.key, fresh.key], np.r_[self.count, fresh.count]
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.key, self.count = key[first], np.add.reduceat(count, first) if len(first) else count
        self.cut(self.held)

    def cut(self, most: int) -> None:
        """No more than ``most`` counters: all lose the count of the next one."""
        if len(self.count) > most:
            lost = int(np.partition(self.count, len(self.count) - most - 1)[len(self.count) - most - 1])
            keep = self.count > lost
            self.key, self.count = self.key[keep], self.count[keep] - lost
            self.error += lost


def summaries(words: DataFrame, most: int) -> DataFrame:
    """h and n: counters summed over all tasks; the row without h has the summed error."""

    def run(batches):
        s, waiting, held = Summary(HELD), [], 0
        for b in batches:
            for _, _, h in gram_hashes(*flat(b.column("w")), most):
                waiting.append(h)
                held += len(h)
            if held >= GATHERED:
                s.add(np.concatenate(waiting))
                waiting, held = [], 0
        if waiting:
            s.add(np.concatenate(waiting))
        s.cut(SENT)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[s.key.view(np.int64), 0], mask=np.r_[np.zeros(len(s.key), bool), True]), pa.array(np.r_[s.count, s.error])], names=["h", "n"])

    return words.select("w").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Lookup:
    """Places of hashes in a sorted array of them; most of those that it lacks are told by their first bits."""

    BITS = 20

    def __init__(self, sorted_hashes: np.ndarray):
        self.hashes = sorted_hashes
        self.there = np.zeros(1 << self.BITS, bool)
        self.there[sorted_hashes >> U(64 - self.BITS)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entries of ``h`` are there, and their places."""
        i = np.flatnonzero(self.there[h >> U(64 - self.BITS)])
        place = np.searchsorted(self.hashes, h[i])
        place[place == len(self.hashes)] = 0
        ok = self.hashes[place] == h[i] if len(i) else np.zeros(0, bool)
        return i[ok], place[ok]


def counted(words: DataFrame, candidates: np.ndarray, most: int) -> DataFrame:
    """h, total, df, and the first place (key, place, k) of each candidate (sorted hashes)."""
    shared = words.sparkSession.sparkContext.broadcast(candidates)

    def run(batches):
        c, look = shared.value, Lookup(shared.value)
        total, df = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        where = np.zeros((len(c), 3), np.int64)
        for b in batches:
            w, row = flat(b.column("w"))
            keys = b.column("key").to_numpy()
            begins = np.searchsorted(row, np.arange(len(keys)))
            for k, at, h in gram_hashes(w, row, most):
                hit, place = look.hits(h)
                at = at[hit]
                of = row[at]
                fresh, first = np.unique(place, return_index=True)
                new = total[fresh] == 0
                where[fresh[new]] = np.stack([keys[of[first[new]]], at[first[new]] - begins[of[first[new]]], np.full(int(new.sum()), k)], axis=1)
                total += np.bincount(place, minlength=len(c))
                pairs = np.unique(place * np.int64(len(keys) + 1) + of)
                df += np.bincount(pairs // (len(keys) + 1), minlength=len(c))
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c[i].view(np.int64)), pa.array(total[i]), pa.array(df[i]), *[pa.array(where[i, j]) for j in range(3)]], names=["h", "total", "df", "key", "place", "k"])

    each = words.mapInArrow(run, "h long, total long, df long, key long, place long, k long")
    return each.groupBy("h").agg(F.sum("total").alias("total"), F.sum("df").alias("df"), F.min(F.struct("key", "place", "k")).alias("at"))


def term_rows(words: DataFrame, terms: np.ndarray, most: int, then=None, schema: str = "key long, h long, n long", carry: str | None = None) -> DataFrame:
    """key, h and n (and ``carry``, a column of ``words``): how often each row has each of these n-grams (sorted hashes); ``then`` makes of these batches, each of whole rows of ``words``, those of ``schema``."""
    shared = words.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        c, look = shared.value, Lookup(shared.value)
        for b in batches:
            w, row = flat(b.column("w"))
            keys, found = b.column("key").to_numpy(), [np.zeros(0, np.int64)]
            for _, at, h in gram_hashes(w, row, most):
                hit, place = look.hits(h)
                found.append(row[at[hit]] * np.int64(len(c)) + place)
            pair, n = np.unique(np.concatenate(found), return_counts=True)
            of = pair // max(len(c), 1)
            carried = [b.column(carry).take(pa.array(of))] if carry else []
            yield pa.RecordBatch.from_arrays([pa.array(keys[of]), pa.array(c[pair % max(len(c), 1)].view(np.int64)), pa.array(n), *carried], names=["key", "h", "n", *[carry] * bool(carry)])

    return words.mapInArrow((lambda batches: then(run(batches))) if then else run, schema)


def most_frequent(df: DataFrame, key: str, text: str, top: int, most: int = 3, min_df: int = 1, max_df: float = 1.0, first: int = 2) -> DataFrame | None:
    """term, h, total, df and n_docs of the ``top`` most frequent n-grams (ties by term) whose df is at least ``min_df`` and at most ``max_df`` of all rows; None if summaries cannot tell.

    first: candidates of the first try, as a multiple of ``top``.
    """
    words = hashed_words(df, key, text)
    n_docs = df.count()
    kept = summaries(words, most).persist()
    try:
        error = kept.filter("h is null").agg(F.sum("n")).head()[0] or 0
        counters = kept.filter("h is not null")
        while True:
            row = counters.select("n").orderBy(F.desc("n")).limit(first * top).agg(F.min("n"), F.count("*")).head()
            reach = row[0] if row[1] == first * top else 0
            # an n-gram that occurs ``sure`` times has a counter of that less the error, and is a candidate
            sure = max(reach, error + 1)
            wanted = counters.filter(F.col("n") >= max(sure - error, 1))
            if wanted.count() > MOST_CANDIDATES:
                return None
            candidates = np.sort(np.array([r["h"] for r in wanted.select("h").collect()], np.int64).view(U))
            exact = counted(words, candidates, most).filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
            exact = exact.persist()
            try:
                place = exact.select("total").orderBy(F.desc("total")).limit(top).agg(F.min("total"), F.count("*")).head()
                whole = error == 0 and reach == 0  # every n-gram is a candidate
                if whole or (place[1] == top and place[0] >= sure):
                    return _with_terms(df, key, text, exact.filter(F.col("total") >= (place[0] or 0)), top, n_docs)
            finally:
                exact.unpersist()
            if reach == 0 or sure == error + 1:
                return None
            first *= 8
    finally:
        kept.unpersist()


def _with_terms(df: DataFrame, key: str, text: str, exact: DataFrame, top: int, n_docs: int) -> DataFrame:
    """The words of the winners, read where they first occur; a table of ``top`` rows made once."""
    per = exact.groupBy(F.col("at.key").alias("k0")).agg(F.collect_list(F.struct("h", "total", "df", "at.place", "at.k")).alias("x"))
    # the words of a row are made once, for all that it has
    found = df.select(F.col(key).cast("long").alias("k0"), text).join(per, "k0").select(grams(F.col(text)).alias("w"), "x").select("w", F.explode("x").alias("x")).select("w", "x.*")
    term = F.array_join(F.slice("w", (F.col("place") + 1).cast("int"), F.col("k").cast("int")), " ")
    winners = found.select(term.alias("term"), "h", "total", "df").orderBy(F.desc("total"), "term").limit(top).collect()
    return df.sparkSession.createDataFrame([(*r, n_docs) for r in winners], "term string, h long, total long, df long, n_docs long")
