"""N-gram Jaccard self-join and its groups, with set-relation skipping.

A document is the set of its word shingles.  Shingles have a global order, rare
ones first (by a fixed-size table of counts over all documents), and a set is
indexed under its first shingles only, with their positions.  Two sets can be
linked only if they meet in such a list at positions that leave enough of both,
so whatever lies beyond that bound is skipped.  Equal sets are one node.

Highly similar sets share their lists, so answers come from a leader's: a list
pairs its members with its first ``LEADERS`` alone, in one order of sets for all
lists.  Entries carry ``ONE_BIT`` minhashes of one bit, which tell most
unrelated sets apart where lists are joined (they pass a link but once in
10**12); pairs whose bit sketches (a bound on the difference of two sets) allow
a link are then checked on whole texts.  Members that share a checked link's
group have their answer and meet no more; only members of one list that lie in
different groups are compared with each other, in cells of ``CELL`` entries:
in rounds, the closest pairs that would make one group of a cell, while that
finds links, and then all pairs that are left.  So the
groups are those that all links give, and every link that is returned was
checked; links inside a group that nothing depends on are looked for at the
end, unless only groups are wanted.

Sets are compared by 64-bit hashes of shingles.  Documents without words (null,
empty or blank) link with nothing; an empty table gives no rows.  A node is a
set, not a doc_id, so rows that repeat a doc_id each get their own text's
answer.  Ties in length or order do not matter to the groups.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, packets, work
from .components import components

#: Cells of the table of counts: a fixed 2 ** 21, whatever the corpus.
CELL_BITS = 21
BLOCKS = 32
#: Least number of bits of a sketch.
SKETCH = 256
#: Members of a list that all others are paired with; a list of one more is covered by them.
LEADERS = 3
#: Entries of a list that meet in one task, and members that meet one copy of a leader's text.
CELL = 1024
#: Minhashes of one bit that an entry carries, and the chance that they pass over a link.
ONE_BIT = 128
MISSED = 1e-12
U = np.uint64


def shingle_sets(s: blocks.Slice, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: k words, or all if there are fewer."""
    low = blocks.LOWER[s.buf]
    start, end, first = blocks.words(low, s.off)
    if not len(start):
        return [np.zeros(0, U)] * (len(s.off) - 1)
    h = blocks.mix(blocks.spans_hash(blocks.prefix_hashes(low), start, end) + (end - start).astype(U))
    acc = np.zeros(max(len(h) - k + 1, 0), U)
    for j in range(k):
        acc = acc * U(0xD6E8FEB86659FD93) + h[j : j + len(acc)]
    acc = blocks.mix(acc)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(acc[a : b - k + 1])
            x = x[np.r_[True, x[1:] != x[:-1]]]
        elif b > a:
            x = np.array([b - a], U)
            for j in range(a, b):
                x = x * U(0xA0761D6478BD642F) + h[j]
            x = blocks.mix(x)
        else:
            x = np.zeros(0, U)
        out.append(x)
    return out


def signature(x: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(x):
        return 0
    total = int(np.sum(blocks.mix(x), dtype=U)) + len(x) * 0x9E3779B97F4A7C15
    return int(blocks.mix(np.array([total & 0xFFFFFFFFFFFFFFFF], U)).view(np.int64)[0])


def sketch_bytes(n: int) -> int:
    """Size of the sketch of a set of n: a power of two, two to four bits a member, ``SKETCH`` bits at least."""
    return max(SKETCH, 1 << max(2 * n - 1, 0).bit_length()) // 8


def sketch(x: np.ndarray) -> np.ndarray:
    """Parities of set sizes by residue: two sketches differ in no more bits than the sets in members."""
    size = 8 * sketch_bytes(len(x))
    return np.packbits(np.bincount((x & U(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1)


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set for fewer residues."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, at the smaller of their sizes."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


_FACTORS = blocks.mix(np.arange(1, ONE_BIT + 1, dtype=U)) | U(1)


def one_bit(x: np.ndarray) -> np.ndarray:
    """The minhashes of a set, one bit of each: similar sets differ in few of them."""
    least = np.full(ONE_BIT, np.iinfo(U).max, U)
    for a in range(0, len(x), 4096):
        np.minimum(least, np.multiply.outer(_FACTORS, x[a : a + 4096]).min(axis=1), out=least)
    return np.packbits((blocks.mix(least) >> U(63)).astype(np.uint8)).view(U)


def most_apart(percent: int) -> int:
    """Most minhashes in which linked sets differ, but for a chance of ``MISSED``."""
    p, t, beyond = (1 - percent / 100) / 2, ONE_BIT, 0.0
    while t and (beyond := beyond + math.comb(ONE_BIT, t) * p**t * (1 - p) ** (ONE_BIT - t)) < MISSED:
        t -= 1
    return t


def all_apart(raw: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``apart`` for many pairs of the sketches in ``raw``."""
    size, out = np.array([len(x) for x in raw]), np.zeros(len(i), np.int64)
    lo, hi = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    for s, b in {*zip(lo.tolist(), hi.tolist(), strict=True)}:
        m = np.flatnonzero((lo == s) & (hi == b))
        for at in range(0, len(m), 10_000):
            k = m[at : at + 10_000]
            x, y = (np.stack([folded(np.frombuffer(raw[v], np.uint8), s) for v in w[k].tolist()]) for w in (i, j))
            out[k] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs, in their order, join what earlier ones have not joined."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[x], out[k] = y, True
    return out


def furthest(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Most members by which linked sets of these sizes can differ."""
    both = a + b
    return both - 2 * -(-percent * both // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _first_pass(docs: DataFrame, k: int) -> DataFrame:
    """Rows with a doc_id, size, signature and sketch for every document; rows with a block for counts of shingles by cell."""
    names = ["doc_id", "n", "sig", "bits", "block", "cells"]

    def run(batches):
        counts, some = np.zeros(1 << CELL_BITS, np.int64), packets.Gather()

        def count():
            counts[:] += np.bincount(some.take()[0], minlength=1 << CELL_BITS)

        for s in blocks.slices(batches):
            sets = shingle_sets(s, k)
            n = np.array([len(x) for x in sets], np.int32)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([pa.array(s.column("doc_id").astype(np.int64)), pa.array(n), pa.array([signature(x) for x in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
            if some.add((np.concatenate(sets) >> U(64 - CELL_BITS)).astype(np.int64)):
                count()
        if some.parts:
            count()
        used = np.flatnonzero(counts)  # only cells that this task has met
        cut = np.searchsorted(used, np.arange(BLOCKS + 1) * ((1 << CELL_BITS) // BLOCKS))
        data = [packets.pack(used[x:y].astype(np.uint32), counts[used[x:y]].astype(np.uint32)) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        none = pa.nulls(BLOCKS)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(data, pa.binary())], names=names)

    return work.texts(docs).mapInArrow(run, "doc_id long, n int, sig long, bits binary, block int, cells binary")


def _commonness(first: DataFrame) -> np.ndarray:
    """Class of each cell, 0 for rare to 15 for the most common; a fixed two megabytes."""
    width = (1 << CELL_BITS) // BLOCKS

    def add(batches):
        by: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column("block"), b.column("cells"), strict=True):
                total = by.setdefault(block.as_py(), np.zeros(width, np.int64))
                at, n = packets.unpack(data.as_py())
                total[at.astype(np.int64) % width] += n
        if by:
            level = [np.minimum(np.rint(4 * np.log2(np.maximum(x, 1))), 255).astype(np.uint8).tobytes() for x in by.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([int(x.sum()) for x in by.values()], pa.int64()), pa.array(level, pa.binary())], names=["block", "total", "level"])

    rows = first.filter("block is not null").select("block", "cells").repartition(BLOCKS, "block").mapInArrow(add, "block int, total long, level binary").collect()
    level = np.zeros((BLOCKS, width), np.uint8)
    for r in rows:
        level[r["block"]] = np.frombuffer(r["level"], np.uint8)
    usual = max(8.0, 2 * sum(r["total"] for r in rows) / (1 << CELL_BITS))
    return np.clip(np.ceil(level.reshape(-1) / 2 - 2 * np.log2(usual)), 0, 15).astype(np.uint8)


def _fits(a, b, n, pos, mini, percent: int, apart_most: int) -> np.ndarray:
    """Whether sizes, positions and minhashes allow a link of the entries ``a`` with ``b``."""
    ok = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (pos[a] + pos[b] <= furthest(n[a], n[b], percent))
    where = np.flatnonzero(ok)
    ok[where] = np.bitwise_count(mini[a[where]] ^ mini[b[where]]).sum(axis=1, dtype=np.int64) <= apart_most
    return ok


def _lists(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """kind 0: candidate pairs of signatures, the leader first; kind 1: entries whose candidates leaders do not cover."""
    spark = docs.sparkSession
    shared, buckets, apart_most = spark.sparkContext.broadcast(common), work.buckets(docs), most_apart(percent)

    def index(batches):
        classes, some, seen = shared.value, packets.Gather(), set()

        def send():
            key, *rest = some.take()
            return packets.dealt((blocks.mix(key) % U(buckets)).astype(np.int32), 0, key, *rest)

        for s in blocks.slices(batches):
            found = []
            for x in shingle_sets(s, k):
                if not len(x) or (sig := signature(x)) in seen:
                    continue
                seen.add(sig)
                key = (classes[(x >> U(64 - CELL_BITS)).astype(np.int64)].astype(U) << U(60)) | (x >> U(4))
                m = prefix_length(len(x), percent)
                lo, hi = one_bit(x)
                found.append((np.sort(key)[:m], np.full(m, sig, np.int64), np.full(m, len(x), np.int32), np.arange(m, dtype=np.int32), np.full(m, lo), np.full(m, hi)))
            if len(seen) > 1 << 20:
                seen.clear()
            if found and some.add(*[np.concatenate(x) for x in zip(*found, strict=True)]):
                yield from send()
        if some.parts:
            yield from send()

    def join(t: pa.Table) -> pa.Table:
        key, sig, n, pos, lo, hi = packets.gathered(t, 0)
        # leaders are the first of a list in an order that is the same in all lists
        order = np.lexsort((pos, blocks.mix(sig.view(U)), key))
        order = order[np.r_[True, (key[order[1:]] != key[order[:-1]]) | (sig[order[1:]] != sig[order[:-1]])]]
        size = np.repeat(*[packets.runs(key[order])[1]] * 2)
        order, size = order[size > 1], size[size > 1]
        key, sig, n, pos, mini = key[order], sig[order], n[order].astype(np.int64), pos[order].astype(np.int64), np.stack([lo[order], hi[order]], axis=1)
        head = np.repeat(*packets.runs(key))
        pairs, open_ = [np.zeros((0, 2), np.int64)], size > CELL
        rank = np.arange(len(key)) - head
        for leader in range(LEADERS):
            to = np.flatnonzero(rank > leader)
            at = head[to] + leader
            ok = _fits(at, to, n, pos, mini, percent, apart_most)
            pairs.append(np.stack([sig[at[ok]], sig[to[ok]]], axis=1))
        # members beside the leaders that may be linked with each other wait for the leaders' answers
        at, gap = np.flatnonzero((rank >= LEADERS) & (size <= CELL)), 1
        while len(at):
            at = at[rank[at] + gap < size[at]]
            ok = _fits(at, at + gap, n, pos, mini, percent, apart_most)
            open_[at[ok]] = open_[at[ok] + gap] = True
            gap += 1
        pairs, out = np.unique(np.concatenate(pairs), axis=0), []
        if len(pairs):
            out.append((0, packets.pack(pairs[:, 0].copy(), pairs[:, 1].copy())))
        if open_.any():
            out.append((1, packets.pack(*(x[open_] for x in (key.view(np.int64), sig, n, pos, mini[:, 0].view(np.int64), mini[:, 1].view(np.int64))))))
        return packets.table([0] * len(out), [x for x, _ in out], [x for _, x in out])

    entries = work.texts(docs).mapInArrow(index, packets.SCHEMA)
    return entries.groupBy("bucket").applyInArrow(join, packets.SCHEMA)


def _rows(packed: DataFrame, names: list[str]) -> DataFrame:
    """Packed 64-bit arrays as rows."""

    def run(batches):
        for b in batches:
            for data in b.column("data"):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in packets.unpack(data.as_py())], names=names)

    return packed.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b (signatures) and doc_a, doc_b (their least doc_ids) of the pairs whose sketches allow a link."""

    def run(batches):
        for t in batches:
            bits = np.array([apart(x, y) for x, y in zip(t.column("bits_a").to_pylist(), t.column("bits_b").to_pylist(), strict=True)], np.int64)
            na, nb = (t.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            ok = pa.array((bits <= furthest(na, nb, percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
            yield pa.RecordBatch.from_arrays([t.column(c).filter(ok) for c in ("a", "b", "doc_a", "doc_b")], names=["a", "b", "doc_a", "doc_b"])

    side = lambda x: sets.select(F.col("sig").alias(x), F.col("doc").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    joined = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(run, "a long, b long, doc_a long, doc_b long")


def _texts(docs: DataFrame, pairs: DataFrame, scratch: work.Scratch) -> DataFrame:
    """doc_id and text of the documents of these pairs, in buckets by doc_id; each text of a doc_id once."""
    wanted = scratch.written(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct(), "wanted")
    # Spark knows the size of the written ids: it broadcasts them up to its threshold and shuffles beyond
    found = work.texts(docs).join(wanted, "doc_id", "left_semi")
    out = scratch.written(found.dropDuplicates(["doc_id", "text"]), "texts", "doc_id")
    scratch.drop(wanted)
    return out


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a and b of the pairs whose shingle sets, taken from whole texts, are similar enough.

    The members' texts move to their leaders'; a leader of many members is
    there in several copies, one for each ``CELL`` of them.
    """

    def run(batches):
        last: dict[str, tuple] = {"a": (None, None, None)}
        for big in batches:
            for at in range(0, big.num_rows, 100):
                t = big.slice(at, 100)
                buf, off = blocks.text_buffers(t.column("text_b"))
                mine = shingle_sets(blocks.Slice(t, buf, off), k)
                keep = []
                for i, (a, b) in enumerate(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True)):
                    text = t.column("text_a")[i].as_py()
                    if last["a"][0] != a or last["a"][1] != text:
                        one = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"])
                        x = shingle_sets(blocks.Slice(one, *blocks.text_buffers(one.column("text"))), k)[0]
                        last["a"] = (a, text, x if signature(x) == a else None)
                    x, y = last["a"][2], mine[i]
                    if x is None or signature(y) != b:  # another text of a repeated doc_id
                        keep.append(False)
                        continue
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    per = pairs.groupBy("a", "doc_a").agg(F.ceil(F.count("*") / CELL).cast("int").alias("copies"))
    lead = per.join(texts.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a")).hint("merge"), "doc_a")
    lead = lead.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    own = pairs.join(per.select("a", "copies"), "a").select("a", "b", "doc_b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    own = own.join(texts.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b")).hint("merge"), "doc_b").select("a", "b", "copy", "text_b")
    return own.join(lead.hint("merge"), ["a", "copy"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose nodes lie in different groups so far."""
    side = lambda x: groups.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return out.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def _cells(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries (key, sig, n, pos, lo, hi, root, main) of the lists whose members lie in different groups, dealt to cells.

    A list's largest group falls into cells of ``CELL``, and all other members
    come to each of these; the others meet each other in cells of their own,
    one for every two blocks of them.
    """
    placed = entries.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", "n", "pos", "lo", "hi", F.coalesce("root", "sig").alias("root"))
    per = placed.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("m"))
    per = per.filter("m > top.m").select("key", F.col("top.root").alias("top"), F.ceil(F.col("top.m") / CELL).cast("int").alias("mains"), F.ceil((F.col("m") - F.col("top.m")) / CELL).cast("int").alias("others"))
    placed = placed.join(per, "key").withColumn("main", F.col("root") == F.col("top"))
    own = F.pmod(F.xxhash64("sig"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    at = lambda i, j: F.col("mains") + F.least(i, j) * F.col("others") + F.greatest(i, j)
    with_mains = F.sequence(F.lit(0), F.col("mains") - 1)
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: at(F.col("own"), j))
    placed = placed.withColumn("own", own)
    cells = F.when(F.col("main"), F.array("own")).otherwise(F.concat(with_mains, with_others))
    return placed.select("key", "sig", "n", "pos", "lo", "hi", "root", "main", F.explode(cells).alias("cell"))


def _candidates(cells: DataFrame, sets: DataFrame, tried: DataFrame, percent: int, closest: bool, buckets: int) -> DataFrame:
    """a, b, doc_a and doc_b of the pairs of a cell that lie in different groups and that positions, sizes, minhashes and sketches allow; with ``closest``, of each cell the closest ones that would make one group of it."""
    apart_most = most_apart(percent)

    def run(t: pa.Table) -> pa.Table:
        key, cell, sig, doc, n, pos, root = (t.column(c).to_numpy().astype(np.int64) for c in ("key", "cell", "sig", "doc", "n", "pos", "root"))
        # unsigned: the bits of a negative number are those of its absolute value to bitwise_count
        lo, hi = (t.column(c).to_numpy().astype(np.int64).view(U) for c in ("lo", "hi"))
        main = t.column("main").to_numpy(zero_copy_only=False)
        raw = t.column("bits").to_pylist()
        order = np.lexsort((pos, cell, key))
        key, cell, sig, doc, n, pos, root, main = (x[order] for x in (key, cell, sig, doc, n, pos, root, main))
        raw = [raw[i] for i in order.tolist()]
        mini = np.stack([lo[order], hi[order]], axis=1)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, len(key)])
        end = np.repeat(first + length, length)
        with_main = np.repeat(np.logical_or.reduceat(main, first), length) if len(first) else main
        most = furthest(n, n * 100 // percent, percent)
        found, at, gap = [np.zeros((0, 3), np.int64)], np.arange(len(key)), 1
        while len(at):
            at = at[at + gap < end[at]]
            # a cell is in the order of positions: once too far, the rest is skipped
            at = at[pos[at] + pos[at + gap] <= most[at]]
            i = at[(root[at] != root[at + gap]) & (~with_main[at] | (main[at] != main[at + gap]))]
            i = i[_fits(i, i + gap, n, pos, mini, percent, apart_most)]
            if len(i):
                bits = all_apart(raw, i, i + gap)
                ok = bits <= furthest(n[i], n[i + gap], percent)
                found.append(np.stack([i[ok], i[ok] + gap, bits[ok]], axis=1))
            gap += 1
        x = np.concatenate(found)
        if closest and len(x):
            x = x[np.argsort(x[:, 2], kind="stable")]
            # roots of different cells are different here
            names = np.unique(np.stack([end, root], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            x = x[forest(names[x[:, 0]], names[x[:, 1]])]
        i, j = x[:, 0], x[:, 1]
        i, j = np.where(sig[i] < sig[j], i, j), np.where(sig[i] < sig[j], j, i)
        return pa.table({"a": sig[i], "b": sig[j], "doc_a": doc[i], "doc_b": doc[j]})

    dealt = cells.join(sets.select("sig", "doc", "bits"), "sig").withColumn("bucket", F.pmod(F.xxhash64("key", "cell"), F.lit(buckets)))
    pairs = dealt.groupBy("bucket").applyInArrow(run, "a long, b long, doc_a long, doc_b long").distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, tables)


def _every(near: DataFrame, entries: DataFrame, sets: DataFrame, tried: DataFrame, groups: DataFrame, percent: int, buckets: int) -> DataFrame:
    """a, b, doc_a and doc_b of all pairs that may be linked and were not tried, whatever their groups."""
    swap = F.col("a") > F.col("b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    led = near.select(either("a", "b"), either("b", "a"), either("doc_a", "doc_b"), either("doc_b", "doc_a")).join(tried, ["a", "b"], "left_anti")
    # without groups each node is one of its own, so all members of a list meet, in cells
    return led.unionByName(_candidates(_cells(entries, groups.filter("false")), sets, tried, percent, False, buckets)).distinct()


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of the join at ``percent`` / 100 on shingles of ``k`` words; both are written tables.

    documents: doc_id, n_shingles, class_id (least doc_id with the same set) and
    component_id for each row; links: a, b, the classes (least doc_ids) of all
    links between different sets, each checked on whole texts.

    every: if false, links are only those that were needed to connect the
    groups.  A group of n sets has up to n * n / 2 links; their pairs meet in
    cells of bounded size.
    """
    scratch = work.Scratch(docs.sparkSession)
    first = scratch.written(_first_pass(docs, k), "sets")
    lists = scratch.written(_lists(docs, k, percent, _commonness(first)), "lists")
    sets = first.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    sets = scratch.written(sets, "classes")
    near = scratch.written(_near(_rows(lists.filter("kind = 0"), ["a", "b"]), sets, percent), "near")
    texts = _texts(docs, near, scratch)
    # leaders first: each node and one leader of it, then what still lies between groups
    tried = near.groupBy("b", "doc_b").agg(F.min(F.struct(F.xxhash64("a"), "a", "doc_a")).alias("x")).select("x.a", "b", "x.doc_a", "doc_b")
    tried = scratch.written(tried, "pairs")
    links = [scratch.written(linked(tried, texts, k, percent), "links")]
    groups = components(links[0])
    rest = scratch.written(_across(near.join(tried, ["a", "b"], "left_anti"), groups), "pairs")
    links.append(scratch.written(linked(rest, texts, k, percent), "links"))
    scratch.drop(*([texts] if every else [near, texts]))
    groups = components(_union(links))
    tried = tried.union(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    entries = _rows(lists.filter("kind = 1"), ["key", "sig", "n", "pos", "lo", "hi"])
    closest = True
    while True:
        pairs = scratch.written(_candidates(_cells(entries, groups), sets, tried, percent, closest, work.buckets(docs)), "pairs")
        found = False
        if not pairs.isEmpty():
            texts = _texts(docs, pairs, scratch)
            links.append(scratch.written(linked(pairs, texts, k, percent), "links"))
            scratch.drop(texts)
            tried = tried.union(pairs.select("a", "b"))
            if found := not links[-1].isEmpty():
                groups = components(_union(links))
        if not closest:
            break
        closest = found  # once the closest pairs give no link, all that are left are looked at
    if every:
        # many small buckets: pairs grow with the square of a group
        pairs = scratch.written(_every(near, entries, sets, tried, groups, percent, 16 * work.buckets(docs)), "pairs")
        texts = _texts(docs, pairs, scratch)
        links.append(scratch.written(linked(pairs, texts, k, percent), "links"))
    of = sets.select("sig", "doc").join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    # a group goes by its least doc_id
    of = of.join(of.groupBy("root").agg(F.min("doc").alias("least")), "root").select("sig", "doc", "least")
    out = first.filter("doc_id is not null").select("doc_id", "n", "sig").join(of, "sig", "left")
    documents = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("doc", "doc_id").alias("class_id"), F.coalesce("least", "doc_id").alias("component_id"))
    documents = scratch.written(documents, "documents")
    every = _union(links)
    for x in ("a", "b"):
        every = every.join(sets.select(F.col("sig").alias(x), F.col("doc").alias(f"doc_{x}")), x)
    every = scratch.written(every.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct(), "links")
    scratch.keep(documents, every)
    return documents, every


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` linked at 0.9 on 3-word shingles."""
    documents, _ = ngram_join(work.read_documents(spark, sf_dir), 3, 90, every=False)
    return documents.select("doc_id", "n_shingles", "component_id", "class_id")
