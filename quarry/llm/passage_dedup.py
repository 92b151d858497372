"""Fuzzy passage dedup by collinear chaining.

Seeds are runs of ``K`` words, those with the least hash of every ``W``
neighbours.  An occurrence of a seed is joined with the seed's first document
and with the one before its own, so a seed of a million
documents gives two million matches.  Matches of two documents on one diagonal are fragments;
fragments in the order of both texts are chained with gap costs, the best
chain before a fragment coming from a Fenwick tree of maxima.  A chain long
enough asks the earlier document for its words and is aligned along the
chain's diagonals.  Seeds are dense and margins wide, so that passages in which
every sixth or seventh word differs are met.  Passages of ``MIN_WORDS`` words or more of which
``IDENTITY`` agree are removed from the later document; the first document
keeps them.

A second round lets all partners meet for the words that the first one left.
An occurrence that reaches into such words meets every smaller doc_id that has
its seed, if ``MANY`` documents at most have it.  A more
frequent seed meets by pairs: with each other repeated seed ``NEAR`` to ``FAR``
words away as one key.  A chain has two seeds ``NEAR`` words apart or more, and
none of its fragments has a gap of more than ``K`` + ``REACH`` words, so such a pair is a
part of it wherever a frequent seed is needed; a frequent line shorter than a
chain gives no match by itself.  Pairs that are frequent as well (lines of
``NEAR`` + ``K`` words or more which are no removed passage) meet all of theirs,
some at a time.  In a document that has a seed or pair more than ``SOME`` times
the r-th occurrence meets the r-th (or last) one only.

Exact repeats do not depend on which documents a seed meets: each word becomes
seven bits of its hash, and the suffix sort finds every run of ``MIN_WORDS``
words that also stands in a smaller doc_id.  Runs that are equal in this form
and agree in less than ``IDENTITY`` of their words are as rare as 2**-77; to
that comes the chance of equal context hashes in ``suffix_dedup``.

A doc_id names one text.  A null text is empty and keeps no words; documents
below ``MIN_WORDS`` words are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, packets, work
from .suffix_dedup import bucket_column, bucket_of, merged, repeated_substrings

K = 5
W = 3
MIN_WORDS = 50
IDENTITY = 0.8
#: Words on either side of a chain that are aligned as well; a chain needs ``MIN_WORDS`` less two of these.
MARGIN = 17
#: Words between two seeds of one fragment.
REACH = 16
#: Cost of a word of gap, on both sides together.
GAP = 0.2
#: Documents of a seed that meets alone in the second round; the words between the beginnings of two seeds that meet as a pair.
MANY = 64
NEAR = MIN_WORDS - 2 * MARGIN - K
FAR = NEAR - 1 + K + REACH
#: Occurrences in one document that all meet.
SOME = 4
#: Fragments of a chain that are screened one by one before it is aligned; more are screened at once.
FEW_FRAGMENTS = 4
#: Matches that are made at a time.
AT_A_TIME = 1 << 18
#: Bytes of ``docs`` for each bucket of seeds, and of the second round's matches.
KEY_BYTES = 4 << 20
MATCH_BYTES = 1 << 20
U = np.uint64

OUT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, first_docs array<long>, text string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("first_docs", pa.list_(pa.int64())), ("text", pa.string())])


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, start and end of each word (A-Z as a-z), and the first word of each row."""
    low = blocks.LOWER[buf]
    start, end, first = blocks.words(low, off)
    h = blocks.mix(blocks.spans_hash(blocks.prefix_hashes(low), start, end) + (end - start).astype(U)) if len(start) else np.zeros(0, U)
    return h, start, end, first


def seeds(s: blocks.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and hash of each seed."""
    h, _, _, first = word_hashes(s.buf, s.off)
    z = np.zeros(0, np.int64)
    if len(h) < K + W:
        return z, z, z.view(U)
    g = np.zeros(len(h) - K + 1, U)
    for j in range(K):
        g = g * U(0xD6E8FEB86659FD93) + h[j : j + len(g)]
    g = blocks.mix(g)
    least = blocks.window_min(g, W)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):  # no window crosses texts
        least[max(a, b - K - W + 2) : b] = 0
    around = np.concatenate([np.zeros(W - 1, U), least, np.zeros(len(g) - len(least), U)])
    at = np.flatnonzero((blocks.window_min(around, W, np.maximum) == g) & (g != 0))
    row = np.searchsorted(first, at, "right") - 1
    return row, at - first[row], g[at]


def _partners(key: np.ndarray, doc: np.ndarray, at: np.ndarray):
    """Entries in the order of key, doc and place, what is to be done with each, and their matches.

    The r-th occurrence in a document meets the r-th (or last) one in the first
    document of the seed and in the document before.  To be done: 0 nothing
    (no other document has the seed), 1 all have met, 2 some have not, 3 as
    well, and more than ``MANY`` documents have the seed.
    """
    order = np.lexsort((at, doc, key))
    k, d, a = key[order], doc[order], at[order].astype(np.int64)
    if not len(k):
        return k, d, a, np.zeros(0, np.uint8), (d, a, d, a)
    own = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
    begin = np.flatnonzero(own)
    size = np.diff(np.r_[begin, len(k)])
    run = np.cumsum(own) - 1
    first, entries = packets.runs(k)
    documents = np.add.reduceat(own.astype(np.int64), first)
    lead = np.repeat(run[first], entries)
    todo = np.where(documents > MANY, 3, np.where((documents > 3) | (entries > documents), 2, 1)) * (documents > 1)
    before = np.maximum(run - 1, lead)
    nth = np.arange(len(k)) - begin[run]
    meets = lambda r: begin[r] + np.minimum(nth, size[r] - 1)
    x, y = np.flatnonzero(run != lead), np.flatnonzero((run != lead) & (before != lead))
    to = np.r_[meets(lead)[x], meets(before)[y]]
    i = np.r_[x, y]
    return k, d, a, np.repeat(todo, entries).astype(np.uint8), (d[i], a[i], d[to], a[to])


def _match_rows(doc, at, other, place, buckets):
    """Each match once; a run of one word has pairs of seeds that give the same ones."""
    o = np.lexsort((place, at, other, doc))
    doc, at, other, place = doc[o], at[o].astype(np.int32), other[o], place[o].astype(np.int32)
    if len(o):
        new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | (other[1:] != other[:-1]) | (place[1:] != place[:-1])]
        doc, at, other, place = doc[new], at[new], other[new], place[new]
    yield from packets.dealt(bucket_of(doc, buckets), 1, doc, at, other, place)


def _by_key(key, doc, *more, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries in the bucket of their key; the names of documents are written once a row."""
    target = ((key >> U(20)) % U(buckets)).astype(np.int32)
    by = np.argsort(target, kind="stable")
    for f, n in zip(*(x.tolist() for x in packets.runs(target[by])), strict=True):
        o = by[f : f + n]
        names, of = np.unique(doc[o], return_inverse=True)
        yield packets.rows([int(target[o[0]])], [kind], [packets.pack(key[o], names, of.astype(np.uint32), *[m[o] for m in more])])


def _keyed(t: pa.Table) -> list[np.ndarray]:
    """The entries of ``_by_key``: key, doc and the rest."""
    parts = [packets.unpack(d.as_buffer()) for d in t.column("data")]
    return [np.concatenate(x) for x in zip(*[(p[0], p[1][p[2]], *p[3:]) for p in parts], strict=True)]


def _matches(docs: DataFrame, buckets: int, keys: int) -> DataFrame:
    """kind 1: doc, word, earlier doc, its word, for seeds that both have; kind 5: doc, word and hash of seeds that several documents have, and what is to be done (``_partners``); in the bucket of doc. keys: number of buckets of seeds."""

    def send(batches):
        some, ids = packets.Gather(), []

        def flush():
            row, at, key = some.take()
            yield from _by_key(key, np.concatenate(ids)[row], at.astype(np.int32), kind=0, buckets=keys)

        base = 0
        for s in blocks.slices(batches):
            row, at, key = seeds(s)
            ids.append(s.column("doc_id").astype(np.int64))
            if some.add(row + base, at, key):
                yield from flush()
                ids, base = [], 0
            else:
                base += len(ids[-1])
        if some.parts:
            yield from flush()

    def join(t: pa.Table) -> pa.Table:
        k, d, a, todo, matches = _partners(*_keyed(t))
        out, m = list(_match_rows(*matches, buckets)), todo > 0
        k, d, a, todo = k[m], d[m], a[m].astype(np.int32), todo[m]
        return packets.as_table([*out, *packets.dealt(bucket_of(d, buckets), 5, d, a, k, todo)])

    sent = work.texts(docs).mapInArrow(work.lean(send), packets.SCHEMA)
    return sent.groupBy("bucket").applyInArrow(work.lean(join), packets.SCHEMA)


def free(doc: np.ndarray, at: np.ndarray, names: np.ndarray, sizes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether the seed at each word reaches outside the spans of its document (names ascending, each with so many numbers of ``spans``)."""
    if not len(spans):
        return np.ones(len(doc), bool)
    place = (np.repeat(np.arange(len(names)), sizes // 2) << 32) + spans[::2]
    i = np.minimum(np.searchsorted(names, doc), len(names) - 1)
    x = np.searchsorted(place, (i << 32) + at, "right") - 1
    return (names[i] != doc) | (x < 0) | (place[x] >> 32 != i) | (at + K > spans[1::2][x])


def pairs_of_seeds(doc: np.ndarray, at: np.ndarray, key: np.ndarray, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of two seeds of a document, ``NEAR`` to ``FAR`` words apart, of which one is frequent; entries in the order of doc and at."""
    first, second = [], []
    for lag in range(1, len(doc)):
        near = (doc[lag:] == doc[:-lag]) & (at[lag:] - at[:-lag] <= FAR)
        if not near.any():
            break
        i = np.flatnonzero(near & (at[lag:] - at[:-lag] >= NEAR) & ((todo[lag:] == 3) | (todo[:-lag] == 3)))
        first.append(i)
        second.append(i + lag)
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64),) * 2


def _left(matches: DataFrame, done: DataFrame, buckets: int, keys: int) -> DataFrame:
    """kind 6: hash, doc, word, words to the second seed (0: there is none) and whether they reach outside removed passages, of seeds and pairs of seeds that have not met all; in the bucket of the hash."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return packets.table([], [], [])
        doc, at, key, todo = packets.gathered(left, 5)
        order = np.lexsort((at, doc))
        doc, at, key, todo = doc[order], at[order].astype(np.int64), key[order], todo[order]
        names, which = np.unique(right.column("doc_id").to_numpy().astype(np.int64), return_index=True)
        spans = right.column("spans").combine_chunks().take(pa.array(which))
        out = free(doc, at, names, pc.list_value_length(spans).to_numpy().astype(np.int64), pc.list_flatten(spans).to_numpy())
        x, (i, j) = np.flatnonzero(todo == 2), pairs_of_seeds(doc, at, key, todo)
        both = blocks.mix(key[i] * U(0xA24BAED4963EE407) + key[j])
        gap = np.r_[np.zeros(len(x), np.int32), (at[j] - at[i]).astype(np.int32)]
        return packets.as_table(_by_key(np.r_[key[x], both], doc[np.r_[x, i]], at[np.r_[x, i]].astype(np.int32), gap, np.r_[out[x], out[i] | out[j]].astype(np.uint8), kind=6, buckets=keys))

    bucket = bucket_column(F.col("doc_id"), buckets).alias("bucket")
    spans = done.filter("n_spans > 0").select(bucket, "doc_id", "spans")
    return matches.filter("kind = 5").groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(work.lean(run), packets.SCHEMA)


def _meetings(left: DataFrame, buckets: int) -> DataFrame:
    """kind 1, as in ``_matches``, for so many buckets: every entry that reaches outside removed passages, with all smaller doc_ids of its key: with all entries there, or, of more than ``SOME``, with the r-th (or last) one as in ``_partners``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, at, gap, out = _keyed(packets.as_table(batches))
        order = np.lexsort((at, doc, key))
        key, doc, at, gap, out = key[order], doc[order], at[order].astype(np.int64), gap[order].astype(np.int64), out[order] > 0
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        begin, run = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.r_[begin, len(key)])
        # a document's places for partners: its entries, or one for all of them
        places = np.where(size <= SOME, size, 1)
        before = np.cumsum(places) - places
        of_place = np.repeat(np.arange(len(begin)), places)
        first = np.repeat(before[run[packets.runs(key)[0]]], packets.runs(key)[1])
        x = np.flatnonzero(out & (before[run] > first))
        number = before[run[x]] - first[x]
        chunk = np.cumsum(number) // AT_A_TIME
        for f, n in zip(*(v.tolist() for v in packets.runs(chunk)), strict=True):
            c = number[f : f + n]
            i = np.repeat(x[f : f + n], c)
            place = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            other = of_place[place]
            j = begin[other] + np.where(size[other] <= SOME, place - before[other], np.minimum(i - begin[run[i]], size[other] - 1))
            p = np.flatnonzero(gap[i] > 0)
            i2, j2 = i[p], j[p]
            yield from _match_rows(np.r_[doc[i], doc[i2]], np.r_[at[i], at[i2] + gap[i2]], np.r_[doc[j], doc[j2]], np.r_[at[j], at[j2] + gap[j2]], buckets)

    return left.groupBy("bucket").applyInArrow(work.lean(run), packets.SCHEMA)


class FenwickMax:
    """Prefix maxima over ranks: a value and where it came from."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def update(self, rank: int, value: tuple[float, int]) -> None:
        i, n = rank + 1, len(self.best)
        while i < n:
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def query(self, rank: int) -> tuple[float, int]:
        """The greatest value at ranks below ``rank``."""
        out = (-1e18, -1)
        while rank > 0:
            if self.best[rank] > out:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def fragments_of(doc: np.ndarray, at: np.ndarray, other: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """The fragments (a row of first word, end and diagonal each) of the matches; of each two documents: the first fragment, how many, and both names."""
    diagonal = place - at
    order = np.lexsort((at, diagonal, other, doc))
    doc, at, other, diagonal = doc[order], at[order], other[order], diagonal[order]
    two = np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])]
    head = np.flatnonzero(two | np.r_[True, (diagonal[1:] != diagonal[:-1]) | (at[1:] > at[:-1] + K + REACH)])
    tail = np.r_[head[1:] - 1, len(at) - 1]
    first = np.flatnonzero(two[head])
    return np.stack([at[head], at[tail] + K, diagonal[head]], axis=1), first, np.diff(np.r_[first, len(head)]), doc[two], other[two]


def chains(at: np.ndarray, place: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Chains of fragments of the matches of two documents."""
    z = np.zeros(len(at), np.int64)
    return chained(fragments_of(z, at, z, place)[0])


def chained(fragments: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Chains of the fragments (first word, end, diagonal) of two documents."""
    fragments = sorted(map(tuple, fragments.tolist()))
    n = len(fragments)
    if n == 1:
        return [fragments]
    ends = sorted({e + g for _, e, g in fragments})
    rank = {e: k for k, e in enumerate(ends)}
    tree, score, back = FenwickMax(len(ends)), [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: fragments[i][1])
    w = 0
    for i, (b, e, g) in enumerate(fragments):
        # fragments that end before this one begins in the text (a seed may overlap its neighbour) may precede it
        while w < n and fragments[waiting[w]][1] <= b + K:
            j = waiting[w]
            if j < i:
                x = fragments[j]
                tree.update(rank[x[1] + x[2]], (score[j] + GAP * (2 * x[1] + x[2]), j))
            elif fragments[j][0] >= b:
                break
            w += 1
        lo, hi = 0, len(ends)
        while lo < hi:
            mid = (lo + hi) // 2
            if ends[mid] <= b + g + K:
                lo = mid + 1
            else:
                hi = mid
        value, j = tree.query(lo)
        gain = value - GAP * (2 * b + g) if j >= 0 else 0.0
        score[i], back[i] = (e - b) + max(0.0, gain), j if gain > 0 else -1
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(fragments[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _requests(matches: DataFrame, buckets: int) -> DataFrame:
    """kind 2: earlier doc, its first word and end, doc, number of fragments, and the fragments; in the bucket of the earlier doc."""

    def run(t: pa.Table) -> pa.Table:
        doc, at, other, place = packets.gathered(t, 1)
        fragments, first, number, doc, other = fragments_of(doc, at.astype(np.int64), other, place.astype(np.int64))
        long = np.maximum.reduceat(fragments[:, 1], first) - np.minimum.reduceat(fragments[:, 0], first) + 2 * MARGIN >= MIN_WORDS
        # a fragment that is alone is its chain
        alone, several = np.flatnonzero(long & (number == 1)), np.flatnonzero(long & (number > 1))
        of, sizes, more = [], [], []
        for i in several.tolist():
            for c in chained(fragments[first[i] : first[i] + number[i]]):
                if c[-1][1] - c[0][0] + 2 * MARGIN >= MIN_WORDS:
                    of.append(i)
                    sizes.append(len(c))
                    more += c
        of, sizes = np.r_[alone, np.array(of, np.int64)], np.r_[np.ones(len(alone), np.int64), np.array(sizes, np.int64)]
        if not len(of):
            return packets.table([], [], [])
        fragments = np.concatenate([fragments[first[alone]], np.array(more, np.int64).reshape(-1, 3)]).astype(np.int32)
        e, d, begin = other[of], doc[of], np.cumsum(sizes) - sizes
        target = bucket_of(e, buckets)
        by = np.argsort(target, kind="stable")
        out = []
        for f, n in zip(*(x.tolist() for x in packets.runs(target[by])), strict=True):
            o = by[f : f + n]
            s = sizes[o]
            flat = fragments[np.repeat(begin[o] - np.cumsum(s) + s, s) + np.arange(int(s.sum()))].reshape(-1)
            out.append((int(target[o[0]]), packets.pack(e[o], d[o], s.astype(np.int32), flat)))
        return packets.table([b for b, _ in out], [2] * len(out), [x for _, x in out])

    return matches.groupBy("bucket").applyInArrow(work.lean(run), packets.SCHEMA)


def _answers(texts: DataFrame, requests: DataFrame, buckets: int) -> DataFrame:
    """kind 3: doc, earlier doc, fragments, and the earlier doc's words around them; in the bucket of doc."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return packets.table([], [], [])
        e, d, n, flat = packets.gathered(right, 2)
        end, to = np.cumsum(n.astype(np.int64)) * 3, bucket_of(d, buckets)
        order = np.argsort(e, kind="stable")
        sorted_e = e[order]
        out: dict[int, list] = {}
        done = set()
        for part in left.to_batches():
            wanted = np.isin(part.column("doc_id").to_numpy(), sorted_e)
            for s in blocks.slices([part.filter(pa.array(wanted))]):
                names = s.column("doc_id").astype(np.int64)
                h, _, _, first = word_hashes(s.buf, s.off)
                for i in range(len(names)):
                    if names[i] in done:
                        continue
                    done.add(names[i])
                    own = (h[first[i] : first[i + 1]] >> U(32)).astype(np.uint32)
                    a, b = np.searchsorted(sorted_e, names[i]), np.searchsorted(sorted_e, names[i], "right")
                    for j in order[a:b].tolist():
                        f = flat[end[j] - 3 * n[j] : end[j]].reshape(-1, 3)
                        lo = max(0, int(f[0, 0] + f[0, 2]) - MARGIN)
                        hi = int(f[-1, 1] + f[-1, 2]) + MARGIN
                        out.setdefault(int(to[j]), []).append((int(d[j]), int(names[i]), lo, f.reshape(-1), own[lo:hi]))
        data = []
        for rows in out.values():
            ints = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
            sizes = [np.array([len(r[k]) for r in rows], np.int32) for k in (3, 4)]
            data.append(packets.pack(*ints, *sizes, np.concatenate([r[3] for r in rows]).astype(np.int32), np.concatenate([r[4] for r in rows])))
        return packets.table(list(out), [3] * len(out), data)

    return texts.groupBy("bucket").cogroup(requests.groupBy("bucket")).applyInArrow(work.lean(run), packets.SCHEMA)


def sums(x: np.ndarray) -> np.ndarray:
    """The sums of the first 0, 1, ... numbers."""
    out = np.zeros(len(x) + 1, np.float64 if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=out[1:])
    return out


def stretches(m: np.ndarray) -> list[tuple[int, int]]:
    """All passages in ``m`` (whether each word agrees): runs of ``MIN_WORDS`` words or more of which ``IDENTITY`` agree, as intervals that do not touch.

    They lie within stretches where agreement (1) outweighs disagreement (-2):
    the best one, then the best ones to its left and right.  Within a stretch
    each begin reaches to the last end at which ``IDENTITY`` still holds.
    """
    out, left = [], [(0, len(m))]
    while left:
        x, y = left.pop()
        if y - x < MIN_WORDS:
            continue
        value = sums(np.where(m[x:y], 1, -2))
        low = np.minimum.accumulate(value)
        stop = int(np.argmax(value - low))
        if value[stop] - low[stop] < (3 * IDENTITY - 2) * MIN_WORDS - 1e-9:  # less than the shortest passage has
            continue
        start = int(np.flatnonzero(value[: stop + 1] == low[stop])[-1])
        left += [(x, x + start), (x + stop, y)]
        if stop - start < MIN_WORDS:
            continue
        excess = sums(m[x + start : x + stop] - IDENTITY)
        best = np.maximum.accumulate(excess[::-1])
        # the last end whose excess is not below that of the begin
        last = len(excess) - 1 - np.searchsorted(best, excess - 1e-6)
        begin = np.flatnonzero((last - np.arange(len(excess)) >= MIN_WORDS)[:-1] & m[x + start : x + stop])
        begins, ends = merged(begin, last[begin])
        out += [(x + start + int(i), x + start + int(j)) for i, j in zip(begins, ends, strict=True)]
    return sorted(out)


def most_agreeing(own: np.ndarray, other: np.ndarray, lo: int, f: list, a: int, b: int) -> int:
    """No fewer than the words that ``align`` finds in agreement: words between two fragments count on both diagonals."""
    n, begin, at = 0, a, a
    for k, (_, stop, g) in enumerate(f):
        end = b if k == len(f) - 1 else min(max(at, stop), b)
        at = end if k == len(f) - 1 else min(max(end, f[k + 1][0]), b)
        x, y = max(begin, lo - g), min(at, lo - g + len(other))
        if y > x:
            n += int(np.count_nonzero(own[x:y] == other[x + g - lo : y + g - lo]))
        begin = end
    return n


def align(own: np.ndarray, other: np.ndarray, lo: int, fragments: np.ndarray) -> list[tuple[int, int]]:
    """The passages of ``own`` that agree with ``other`` (which begins at word ``lo`` of its text), along the chain.

    Between two fragments the diagonal changes where most words agree.
    """
    f = fragments.reshape(-1, 3)
    a, b = max(0, int(f[0, 0]) - MARGIN), min(len(own), int(f[-1, 1]) + MARGIN)
    few = IDENTITY * MIN_WORDS - 1e-9  # too few for the shortest passage
    if len(f) <= FEW_FRAGMENTS and most_agreeing(own, other, lo, f.tolist(), a, b) < few:
        return []

    def agree(at: np.ndarray) -> np.ndarray:
        """Whether words agree with those at these places."""
        at, words = at - lo, own[a:b] if len(at) == b - a else own[between]
        ok = (at >= 0) & (at < len(other))
        return ok & (words == other[np.where(ok, at, 0)]) if len(other) else ok & False

    if b <= a:
        return []
    place = np.arange(a, b)
    if len(f) == 1:
        return [(a + x, a + y) for x, y in stretches(agree(place + int(f[0, 2])))]
    # fragments and what is between two of them take turns; nothing begins before the end of what precedes it
    border = np.empty(2 * len(f), np.int64)
    border[0], border[1:-1] = a, f[:, :2].reshape(-1)[1:-1]
    border = np.minimum(np.maximum.accumulate(border), b)
    border[-1] = b
    turn = np.repeat(np.arange(2 * len(f) - 1), border[1:] - border[:-1])
    m = agree(place + f[turn >> 1, 2])
    open_ = np.flatnonzero(turn & 1)
    if len(open_):
        between = place[open_]
        x, y = m[open_], agree(between + f[(turn[open_] >> 1) + 1, 2])
        if np.count_nonzero(m) + np.count_nonzero(y) < few:
            return []
        # the words of each space that stay on the first diagonal: as many as bring most agreement, the fewest of such
        first, n = packets.runs(turn[open_])
        total = sums(x.astype(np.int64) - y)
        gain = total[1:] - np.repeat(total[first], n)
        most = np.maximum(np.maximum.reduceat(gain, first), 0)
        best = np.flatnonzero(gain == np.repeat(most, n))
        at = np.searchsorted(best, first)  # a space that gains nothing may have none of its own
        cut = np.where(most > 0, best[np.minimum(at, len(best) - 1)] + 1 if len(best) else 0, first)
        m[open_] = np.where(np.arange(len(x)) < np.repeat(cut, n), x, y)
    return [(a + x, a + y) for x, y in stretches(m)]


def _exact(docs: DataFrame, bucket, buckets: int, scratch: work.Scratch) -> DataFrame:
    """doc_id, spans (words), sources and bucket of documents with runs of ``MIN_WORDS`` words that a smaller doc_id has as well."""

    def code(batches):
        for s in blocks.slices(batches):
            h, _, _, first = word_hashes(s.buf, s.off)
            letters = (h >> U(57)).astype(np.uint8)
            long = np.flatnonzero(np.diff(first) >= MIN_WORDS)
            coded = [letters[first[i] : first[i + 1]].tobytes().decode() for i in long.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(s.column("doc_id")[long], pa.int64()), pa.array(coded, pa.string())], names=["doc_id", "text"])

    # written, so that no task has the workers of two steps
    coded = scratch.written(work.texts(docs).mapInArrow(work.lean(code), "doc_id long, text string"), "coded")
    found = repeated_substrings(coded, MIN_WORDS, sources=True, buckets=buckets).filter("n_spans > 0")
    scratch.drop(coded)
    return found.select("doc_id", "spans", "sources", bucket)


def repeated_passages(docs: DataFrame, whole: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed (words), n_spans, kept_sha256, spans (words: begin, end, begin, ...), first_docs (where the passages stay) and the text that is left.

    whole: with ``row``, a struct of the other columns of ``docs``, whatever their names.
    """
    spark = docs.sparkSession
    scratch, buckets, keys = work.Scratch(spark), work.buckets(docs), work.buckets(docs, KEY_BYTES)
    bucket = bucket_column(F.col("doc_id").cast("long"), buckets).alias("bucket")
    texts = work.texts(docs, bucket)
    others = [F.col(work.quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    row = [F.struct(*others).alias("row")] if whole and others else []
    rows_too = work.texts(docs, bucket, *row)
    out_schema = spark.createDataFrame([], OUT).schema
    if row:
        out_schema = out_schema.add(rows_too.schema["row"])
    with_row = bool(row)
    matches = scratch.written(_matches(docs, buckets, keys), "matches")
    requests = scratch.written(_requests(matches.filter("kind = 1"), buckets), "requests")
    answers = scratch.written(_answers(texts, requests, buckets), "answers")
    scratch.drop(requests)

    def send(t: pa.Table) -> pa.Table:
        spans, sources = t.column("spans").combine_chunks(), t.column("sources").combine_chunks()
        data = packets.pack(t.column("doc_id").to_numpy().astype(np.int64), *(f(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (spans, sources) for f in (pc.list_value_length, pc.list_flatten)))
        return packets.table([t.column("bucket")[0].as_py()], [4], [data])

    answers = answers.unionByName(_exact(docs, bucket, buckets, scratch).groupBy("bucket").applyInArrow(work.lean(send), packets.SCHEMA))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        z = np.zeros(0, np.int64)
        d, e, lo, nf, nw, flat, words = packets.gathered(right, 3) or (z, z, z, z, z, z, z)
        f_end, w_end = np.cumsum(nf.astype(np.int64)), np.cumsum(nw.astype(np.int64))
        order = np.argsort(d, kind="stable")
        sorted_d = d[order]
        exact = {}
        names, n, spans, m, others = packets.gathered(right, 4) or (z, z, z, z, z)
        for x, y, u in zip(names.tolist(), np.split(spans, np.cumsum(n)[:-1]), np.split(others, np.cumsum(m)[:-1]), strict=False):
            exact[x] = (y, u)
        rows = []
        for part in left.to_batches():
            for s in blocks.slices([part]):
                names = s.column("doc_id").astype(np.int64)
                h, start, end, first = word_hashes(s.buf, s.off)
                for i, name in enumerate(names.tolist()):
                    a, b = np.searchsorted(sorted_d, name), np.searchsorted(sorted_d, name, "right")
                    w0, w1 = first[i], first[i + 1]
                    text = s.text(i)
                    begins, stops, sources = [], [], set()
                    if a < b:
                        own = (h[w0:w1] >> U(32)).astype(np.uint32)
                        for j in order[a:b].tolist():
                            for x, y in align(own, words[w_end[j] - nw[j] : w_end[j]], int(lo[j]), flat[f_end[j] - nf[j] : f_end[j]]):
                                begins.append(x)
                                stops.append(y)
                                sources.add(int(e[j]))
                    begin, stop = merged(np.array(begins, np.int64), np.array(stops, np.int64))
                    if name in exact:
                        x, y = exact[name][0][::2], exact[name][0][1::2]
                        at = np.searchsorted(begin, x, "right") - 1
                        if not len(begin) or (at < 0).any() or (stop[at] < y).any():
                            sources.update(exact[name][1].tolist())
                            begin, stop = merged(np.r_[begin, x], np.r_[stop, y])
                    if len(begin):
                        kept, at = [], 0
                        for x, y in zip(begin.tolist(), stop.tolist(), strict=True):
                            kept.append(text[at : start[w0 + x] - s.off[i]])
                            at = end[w0 + y - 1] - s.off[i]
                        text = b"".join([*kept, text[at:]])
                    spans = np.stack([begin, stop], axis=1).reshape(-1).tolist()
                    rows.append((name, int(w1 - w0), int((stop - begin).sum()), len(begin), hashlib.sha256(text).hexdigest(), spans, sorted(sources), text.decode("utf-8", "replace")))
        columns = zip(*rows, strict=True) if rows else [[]] * len(_OUT)
        out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)
        return out.append_column("row", left.column("row")) if with_row else out

    finished = lambda rows, found: rows.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(work.lean(finish), out_schema)
    done = scratch.written(finished(rows_too, answers), "passages")
    scratch.keep(done, matches)
    # the second round: all partners of the words that are left
    left = scratch.written(_left(matches, done, buckets, keys), "left")
    scratch.drop(matches)
    # its matches go straight to a shuffle: they press well, so a file of them is read in far too large pieces
    requests = scratch.written(_requests(_meetings(left, work.buckets(docs, MATCH_BYTES)), buckets), "requests")
    scratch.drop(left)
    answers = scratch.written(_answers(texts, requests, buckets), "answers")
    scratch.drop(requests)

    def asked(batches):
        for b in batches:
            for data in b.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(packets.unpack(data)[0]))], names=["doc_id"])

    changed = scratch.written(answers.mapInArrow(work.lean(asked), "doc_id long").distinct(), "changed")
    there = done.filter("n_spans > 0").select("doc_id", "spans", F.col("first_docs").alias("sources"), bucket).join(changed, "doc_id", "left_semi")
    answers = answers.unionByName(there.groupBy("bucket").applyInArrow(work.lean(send), packets.SCHEMA))
    return done.join(changed, "doc_id", "left_anti").unionByName(finished(rows_too.join(changed, "doc_id", "left_semi"), answers))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that ``documents`` repeats, exactly or nearly, from all but their first document."""
    return repeated_passages(work.read_documents(spark, sf_dir))
