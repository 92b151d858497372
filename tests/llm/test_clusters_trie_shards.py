"""Clustering, the prefix trie and sharding against plain versions, with small bounds so that every path is taken."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from quarry.llm import centroids, prefix_trie, sharding, work


def by_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# clustering


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    c = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:k]]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda x: min((dist(x, y), j) for j, y in enumerate(c))[1]
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in kept:
            groups[best(x)].append(x)
        c = [[sum(v) // len(groups[j]) for v in zip(*groups[j])] if groups[j] else y for j, y in enumerate(c)]
    return sorted(((i, best(x), min(dist(x, c[best(x)]), 2**63 - 1)) for i, x in kept), key=repr), c


VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(seed: int, n: int, dims: int, spread: float = 0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)], 0) for i in range(n)]
    rows += [(3, rows[3][1], 0), (3, rows[3][1], 0), (4, rows[9][1], 0)]  # repeated rows, and an id with two vectors
    rows += [(900, None, 0), (901, [1.0] * (dims - 1), 0), (902, [None] + [1.0] * (dims - 1), 0), (903, [math.nan] * dims, 0), (904, [math.inf] * dims, 0), (None, [0.25] * dims, 0)]
    return rows


@pytest.mark.parametrize("seed,block,n,partitions", [(1, 512, 300, 3), (2, 7, 200, 5)])
def test_clusters(spark, monkeypatch, seed, block, n, partitions):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = vectors(seed, n, 8)
    want, c = plain_clusters([r[:2] for r in rows], 5, 6, 8)
    got, centres, looks = centroids.clusters(spark.createDataFrame(rows, VECTORS).repartition(partitions), 5, 6, 8)
    assert by_rows(got.select("vec_id", "cluster", "distance")) == want and centres.tolist() == c
    assert looks[0] == len(want) and sum(looks[1:]) < 0.8 * len(want) * (len(looks) - 1)  # bounds spare looks
    out = centroids.with_inertia(got, centres).collect()
    per = collections.Counter()
    for _, k, d in want:
        per[k] += d
    assert all(r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values()) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest() for r in out)


def test_clusters_of_ties_and_few(spark):
    """Equal vectors, fewer vectors than clusters, huge components and no vectors at all."""
    same = [(i, [0.5, -0.5], 0) for i in range(20)] + [(50, [0.5, -0.25], 0)]
    for rows, k in ((same, 4), (same[:3], 8), ([(i, [float(i) * 1e6, -1e12 * i], 0) for i in range(9)], 3), ([(i, [1e300 * i, 2.0], 0) for i in range(5)], 2)):
        want, c = plain_clusters([r[:2] for r in rows], k, 4, 2)
        got, centres, _ = centroids.clusters(spark.createDataFrame(rows, VECTORS), k, 4, 2)
        assert by_rows(got.select("vec_id", "cluster", "distance")) == want and [[int(v) for v in row] for row in centres.tolist()] == c
    empty, _, looks = centroids.clusters(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and looks == []


def test_heaps_keep_their_order():
    rng = np.random.default_rng(0)
    h = centroids.Heaps([[] for _ in range(3)])
    gap = rng.random(50)
    h.push(np.arange(50), rng.integers(0, 3, 50).astype(np.int32), gap, [0.0, 1.0, 2.0])
    again = centroids.Heaps.unpacked(h.packed())
    assert again.heaps == h.heaps
    rows, left = again.expired([0.5, 1.5, 2.5])
    assert set(rows.tolist()) == {i for i in range(50) if gap[i] <= 0.5} and len(again.clusters()) == 50 - len(rows) if len(rows) == 0 else True
    assert len(rows) == len(left) and sum(map(len, again.heaps)) == 50 - len(rows)


# trie


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            t = (role or "", text or "")
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest(), t))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:])
    members = collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode().split()) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if full[c] == p).encode()).hexdigest()) for p, m in members.items()), key=repr)


TURNS = "conv_id long, turn long, role string, text string, depth int"


def talks(seed: int) -> list[tuple]:
    """Conversations that branch off one another at many depths, copies, a very long one, null turns and texts."""
    rng = random.Random(seed)
    words = lambda: " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9)))
    talk = lambda n: [(rng.choice(["user", "assistant", None]), words()) for _ in range(n)]
    first, out = talk(1), {}
    for c in range(0, 400, rng.choice((1, 2))):
        kind = rng.random()
        if kind < 0.5 and out:  # the beginning of another one, and turns of its own
            other = out[rng.choice(list(out))]
            out[c] = other[: rng.randint(0, len(other))] + talk(rng.randint(0, 3))
        else:
            out[c] = first + talk(rng.randint(0, 5)) if kind < 0.9 else talk(rng.randint(1, 4))
    out[140] = talk(700)
    out[141], out[142] = list(out[140]), out[140][:350] + talk(2)
    out |= {c: list(out[0]) for c in range(500, 560)} | {-5: talk(3), -21: talk(2)}
    rows = [(c, None if i == 0 and c % 3 == 0 else i, *t, 1) for c, turns in out.items() for i, t in enumerate(turns)]
    return rows + [(None, 1, "user", "nobody's", 1), (7, 2, None, None, 1), (7, 2, "user", None, 1), (7, 2, "user", None, 1)]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed,whole,gathered,stretch", [(1, 2048, 4096, 4096), (2, 8, 3, 50)])
def test_trie(spark, monkeypatch, seed, whole, gathered, stretch):
    for name, value in (("WHOLE", whole), ("GATHERED", gathered), ("STRETCH", stretch)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = talks(seed)
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(3))
    assert got.columns == COLUMNS and by_rows(got) == plain_trie([r[:4] for r in rows])


def test_trie_of_little(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    for rows in ([(None, 1, "a", "b", 0)], [(41, 1, None, None, 0)], [(c, 0, "user", "hi", 0) for c in range(30)]):
        assert by_rows(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == plain_trie([r[:4] for r in rows])


def test_subtree_sums():
    rng = random.Random(3)
    for n in (1, 2, 40, 300):
        parent = [-1 if i == 0 or rng.random() < 0.03 else rng.randrange(max(0, i - 3), i) for i in range(n)]
        own = np.array([[rng.randrange(9), 1] for _ in range(n)])
        want = own.copy()
        for v in range(n - 1, 0, -1):
            if parent[v] >= 0:
                want[parent[v]] += want[v]
        assert (prefix_trie.subtree_sums(parent, own) == want).all()
    assert prefix_trie.subtree_sums([], np.zeros((0, 2))).shape == (0, 0)


# shards

DOCS = "doc_id long, text string, shard string, slot int, size string"


def shelves(seed: int, n: int = 400) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, "é" * rng.randint(0, 400), "s", 1, "z") for i in range(n)]
    rows += [(n, None, "s", 1, "z"), (n + 1, "", None, None, None), (None, "no id", "s", 1, "z"), (n + 2, "x" * 9000, "s", 1, "z")]
    return rows + [(7, "a hot id", "s", 1, "z")] * 900 + [(7, "b" * k, "s", 1, "z") for k in range(300)]


@pytest.mark.parametrize("group_rows,shards", [(1 << 20, 24), (50, 5)])
def test_shards(spark, monkeypatch, group_rows, shards):
    monkeypatch.setattr(sharding, "GROUP_ROWS", group_rows)
    rows = shelves(group_rows)
    got = sharding.shard_rows(spark.createDataFrame(rows, DOCS).repartition(4), shards).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    loads, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(shards)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(loads.values()) / shards
    assert max(loads.values()) - min(loads.values()) <= max(0.15 * mean, 9008)
    spread = {r.shard for r in got if r.doc_id == 7}
    assert len(spread) > shards / 3  # a hot id does not fill one shard
    assert all(len({r.virtual_slot for r in got if r.doc_id == i}) == 1 for i in (7, 8, 9))


def test_maps_are_edited(spark, tmp_path):
    """A second call finds the stored map and keeps it; one more shard takes its share from all others, who exchange nothing."""
    path, docs = f"file://{tmp_path}/map", spark.createDataFrame([r for r in shelves(1) if r[0] not in (7, 402)], DOCS)
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs, 6, path).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs, 6, path).collect()} == one
    assert sharding.rebalanced(spark, path, 7) == 3
    old, new = ({(r.virtual_slot, r.piece): r.shard for r in sharding.read_map(spark, path, v).collect()} for v in (2, 3))
    moved = {u for u in old if old[u] != new[u]}
    assert {new[u] for u in moved} == {6} and {old[u] for u in moved} == set(range(6)) and len(moved) < len(old) / 5
    held = collections.Counter()
    for r in sharding.read_map(spark, path).collect():
        held[r.shard] += r.bytes
    assert max(held.values()) <= 1.05 * sum(held.values()) / 7
    assert sharding.rebalanced(spark, path, 5) == 4  # shards that go give all they have
    assert {r.shard for r in sharding.read_map(spark, path).collect()} == set(range(5))


def test_written_shards(spark, tmp_path):
    rows = shelves(2)
    docs = spark.createDataFrame(rows, DOCS)
    docs = docs.withColumnsRenamed({"slot": "x.y"})
    sharding.write_shards(docs, f"file://{tmp_path}/out", 6)
    back = spark.read.parquet(f"file://{tmp_path}/out/rows")
    key = lambda r: repr((r["doc_id"], r["text"], r["shard"], r["x.y"], r["size"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
    held = {r["shard_"]: r["n"] for r in back.groupBy("shard_").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    stored = collections.Counter()
    for r in sharding.read_map(spark, f"file://{tmp_path}/out/map").collect():
        stored[r.shard] += r.rows
    assert held == dict(stored)


def test_no_shards(spark):
    assert sharding.shard_rows(spark.createDataFrame([], DOCS)).count() == 0 and sharding.dealt({}, 3) == {} and sharding.edited({}, {}, 2) == {}
    assert work.parts(spark) > 0
