"""Fingerprints and weak supervision against plain versions in Python, value for value."""

import collections
import math
import random
import re

import pytest
import xxhash

from quarry.llm import fingerprints, quality_rules

M32 = 0xFFFFFFFF


def signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def hash64(*words: str) -> int:
    """Spark's xxhash64 of strings: each is hashed with what came before as its seed."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return signed(seed, 64)


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & M32


def _mix(h: int, k: int) -> int:
    k = _rotl((k * 0xCC9E2D51) & M32, 15) * 0x1B873593 & M32
    return (_rotl(h ^ k, 13) * 5 + 0xE6546B64) & M32


def _final(h: int, n: int) -> int:
    h ^= n
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & M32
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & M32
    return h ^ (h >> 16)


def hash32(values: list[int]) -> int:
    """Spark's murmur3 of longs."""
    seed = 42
    for v in values:
        v &= (1 << 64) - 1
        seed = _final(_mix(_mix(seed, v & M32), v >> 32), 8)
    return signed(seed, 32)


def hash32_text(text: str) -> int:
    """Spark's murmur3 of a string: whole words of four bytes, then single bytes."""
    b, h = text.encode(), 42
    for i in range(0, len(b) // 4 * 4, 4):
        h = _mix(h, int.from_bytes(b[i : i + 4], "little"))
    for x in b[len(b) // 4 * 4 :]:
        h = _mix(h, (x - 256 if x > 127 else x) & M32)
    return signed(_final(h, len(b)), 32)


def plain_anchors(text: str) -> list[tuple[int, int]]:
    """Runs of K words of whose inner runs of S words one at an edge has the least hash."""
    k, s = fingerprints.K, fingerprints.S
    w = [x for x in re.split(fingerprints.CUT, text) if x]
    if len(w) < k:
        return [(0, hash32_text(text))] if text else []
    inner = [hash64(*w[i : i + s]) for i in range(len(w) - s + 1)]
    out = []
    for i in range(len(w) - k + 1):
        own = inner[i : i + k - s + 1]
        if min(own[0], own[-1]) == min(own):
            out.append((i, hash32(own[::s])))
    return out


def plain_fingerprint(text: str) -> list[int]:
    return sorted({h for _, h in plain_anchors(text)})[: fingerprints.KEEP]


def plain_likeness(a: list[int], b: list[int]) -> float:
    both = sorted(set(a) | set(b))[: fingerprints.KEEP]
    return len([x for x in both if x in a and x in b]) / len(both) if both else 1.0


def texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: rng.choice(["é", "日", "the", "and"]) if rng.random() < 0.2 else f"w{rng.randrange(400)}"
    long = [word() for _ in range(700)]
    out = [None, "", " \n ", "one two", "日本語テキストの短い文です", "a b c d e f", " ".join(long), " ".join(long[:350] + [word() for _ in range(300)])]
    return out + ["\t".join(word() for _ in range(rng.choice((5, 6, 7, 40, 200)))) for _ in range(20)]


def test_anchors_value_for_value(spark):
    rows = [(5 * i, t) for i, t in enumerate(texts(2))]
    found = collections.defaultdict(list)
    for r in fingerprints.anchors(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id].append((r.pos, r.hash))
    assert {i: sorted(found[i]) for i, _ in rows} == {i: plain_anchors(t or "") for i, t in rows}


def test_fingerprints_value_for_value(spark):
    rows = [(5 * i, t) for i, t in enumerate(texts(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hexed = lambda x: "".join(f"{h & M32:08x}" for h in x)
    nxt = dict(zip([i for i, _ in rows], [t or "" for _, t in rows[1:] + rows[:1]], strict=True))
    for r in fingerprints.fingerprint_edits(docs).collect():
        t = dict(rows)[r.doc_id] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[r.doc_id][:half]
        a, b, c = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(nxt[r.doc_id])
        assert (r.fingerprint.lower(), r.edited_fingerprint.lower()) == (hexed(a), hexed(b))
        assert (r.near_edited, r.near_next) == pytest.approx((plain_likeness(a, b), plain_likeness(a, c)))


def plain_em(rows: list[tuple[int, ...]], rounds: int) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern of votes: two classes, rules that are right with a chance of their own and may abstain."""
    n, rules = collections.Counter(rows), len(rows[0])
    prior, good, bad = 0.8, [0.995] * rules, [0.6] * rules
    clip = lambda x: min(0.999, max(0.001, x))

    def posterior(v):
        chance = lambda p: sum(math.log(p[j]) if x == 1 else math.log(1 - p[j]) if x == -1 else 0 for j, x in enumerate(v))
        return 1 / (1 + math.exp(min(600, chance(bad) + math.log(1 - prior) - chance(good) - math.log(prior))))

    for _ in range(rounds):
        q = {v: posterior(v) for v in n}
        share = lambda j, w: clip((sum(n[v] * w(v) for v in n if v[j] == 1) + 1) / (sum(n[v] * w(v) for v in n if v[j]) + 2))
        prior = clip((sum(n[v] * q[v] for v in n) + 1) / (len(rows) + 2))
        good, bad = [share(j, lambda v: q[v]) for j in range(rules)], [share(j, lambda v: 1 - q[v]) for j in range(rules)]
    return {v: posterior(v) for v in n}


@pytest.mark.parametrize("seed,rules", [(1, 4), (2, 9)])
def test_weak_supervision_value_for_value(spark, seed, rules):
    rng = random.Random(seed)
    right = [rng.uniform(0.6, 0.99) for _ in range(rules)]
    rows = []
    for _ in range(600):
        truth = 1 if rng.random() < 0.7 else -1
        rows.append(tuple(0 if rng.random() < 0.25 else truth if rng.random() < p else -truth for p in right))
    voted = spark.createDataFrame([(list(v),) for v in rows], "votes array<int>").repartition(4)
    want = plain_em(rows, quality_rules.ROUNDS)
    got = {tuple(r.votes): r.p_good for r in quality_rules.accuracies(voted, rules).collect()}
    assert set(got) == set(want) and all(got[v] == pytest.approx(want[v], abs=1e-6) for v in want)
    assert quality_rules.accuracies(voted.limit(0), rules).count() == 0
