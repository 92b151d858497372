"""What keeps tasks of op8_passage_dedup and the pipeline small."""

import time

import numpy as np
import pyarrow as pa

from quarry.llm import packets, passage_dedup, suffix_dedup, work


def test_each_match_travels_once():
    a, b = np.array([7, 7, 7, 8]), np.array([3, 3, 4, 3])
    rows = pa.Table.from_batches(passage_dedup._match_rows(a, b, a - 5, b + 1, 4))
    got = packets.gathered(rows, 1)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == [(7, 3, 2, 4), (7, 4, 2, 5), (8, 3, 3, 4)]


def test_parquet_batches_are_short(spark):
    """Rows that carry arrays are long; 4,096 of them at a time do not fit in an executor."""
    work.small_batches(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256


def test_screen_loses_no_passage(monkeypatch):
    rng, found = np.random.default_rng(3), 0
    for _ in range(400):
        own = rng.integers(0, 9, 150).astype(np.uint32)
        other, fragments, at = np.where(rng.random(150) < rng.choice([0.05, 0.15, 0.3]), 9, own), [], int(rng.integers(0, 30))
        for _ in range(rng.integers(1, 4)):
            fragments.append((at, at + int(rng.integers(5, 30)), int(rng.choice([0, 0, 0, 2]))))
            at = fragments[-1][1] + int(rng.integers(-3, 15))
        f, lo = np.array(fragments), max(0, fragments[0][0] + fragments[0][2] - passage_dedup.MARGIN)
        other = other[lo : fragments[-1][1] + fragments[-1][2] + passage_dedup.MARGIN]
        got = passage_dedup.align(own, other, lo, f)
        with monkeypatch.context() as m:
            m.setattr(passage_dedup, "most_agreeing", lambda *_: 1e9)
            want = passage_dedup.align(own, other, lo, f)
        assert got == want
        found += bool(want)
    assert found > 20


def test_packed_numbers_press_well():
    """Numbers and places take about the bytes that differ; short, empty and cut arrays come back as they were."""
    rng = np.random.default_rng(1)
    ids, places = np.sort(rng.integers(0, 1 << 18, 20000)), rng.integers(0, 4000, 20000).astype(np.int32)
    data = packets.pack(ids, places)
    assert len(pa.compress(data, codec="lz4", asbytes=True)) < 0.5 * len(data)
    for n in (0, 1, 63, 64, 1000):
        arrays = [rng.integers(0, 200, 2 * n).astype(t)[::2] for t in packets._TYPES]
        for x, y in zip(arrays, packets.unpack(packets.pack(*arrays)), strict=True):
            assert x.dtype == y.dtype and x.tolist() == y.tolist()


def test_suffix_dedup_writes_no_texts(spark, monkeypatch):
    """Its tables hold places and windows; a text that is not settled is read again."""
    tables, written = {}, work.Scratch.written

    def noted(self, df, name, key=None):
        out = written(self, df, name, key)
        tables[name] = (df.columns, out.filter("kind = 1").count() if name == "covered" else 0)
        return out

    monkeypatch.setattr(work.Scratch, "written", noted)
    line, other = "a line of sixty bytes that is in every one of them, and more", "what stands before it differs from text to text in this place"
    docs = spark.createDataFrame([(i, f"{i} {other[i:]} {line} {other[: 3 * i]} {i}" * 2) for i in range(8)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_substrings(docs).collect()}
    assert len(got) == 8 and got[0] == 0 and all(got[i] >= 120 for i in range(1, 8))
    assert tables["covered"][1] > 0 and "sorted" in tables and not any("text" in columns for columns, _ in tables.values())


def plain_align(own, other, lo, f):
    """Word by word: each space between two fragments changes its diagonal once, where most words agree."""
    a, b = max(0, f[0][0] - passage_dedup.MARGIN), min(len(own), f[-1][1] + passage_dedup.MARGIN)
    same = lambda i, g: 0 <= i + g - lo < len(other) and own[i] == other[i + g - lo]
    m, at = [], a
    for k, (_, stop, g) in enumerate(f):
        end = b if k == len(f) - 1 else min(max(at, stop), b)
        m += [same(i, g) for i in range(at, end)]
        at = end
        if k < len(f) - 1 and (nxt := min(max(at, f[k + 1][0]), b)) > at:
            x, y = ([same(i, d) for i in range(at, nxt)] for d in (g, f[k + 1][2]))
            cut = max(range(len(x) + 1), key=lambda c: sum(x[:c]) + sum(y[c:]))
            m += x[:cut] + y[cut:]
            at = nxt
    return [(a + x, a + y) for x, y in passage_dedup.stretches(np.array(m, bool))]


def test_align_against_a_plain_one():
    rng, found = np.random.default_rng(7), 0
    for _ in range(300):
        own = rng.integers(0, int(rng.choice([3, 50])), int(rng.integers(60, 300))).astype(np.uint32)
        other, f, at = np.where(rng.random(len(own)) < rng.choice([0.02, 0.1, 0.3]), 99, own), [], int(rng.integers(0, 30))
        for _ in range(rng.integers(1, 12)):
            f.append((at, at + int(rng.integers(5, 30)), int(rng.choice([0, 0, 0, 2, -3]))))
            at = f[-1][1] + int(rng.integers(-5, 22))
        lo = max(0, f[0][0] + f[0][2] - passage_dedup.MARGIN)
        other = other[lo : max(lo, f[-1][1] + f[-1][2] + passage_dedup.MARGIN)]
        got = passage_dedup.align(own, other, lo, np.array(f, np.int32).reshape(-1))
        assert got == plain_align(own, other, lo, f)
        found += bool(got)
    assert found > 50


def test_time_of_a_chain_follows_its_words():
    """A chain of many fragments takes no more than some times that of few over as many words (77 times before)."""
    own = np.random.default_rng(2).integers(0, 1 << 30, 8000).astype(np.uint32)

    def seconds(n):
        f = np.array([(i, i + 5, i // (8000 // n) % 2) for i in range(0, 8000 - 8000 // n, 8000 // n)], np.int32).reshape(-1)
        each = []
        for _ in range(7):
            start = time.perf_counter()
            passage_dedup.align(own, own, 0, f)
            each.append(time.perf_counter() - start)
        return min(each)

    assert seconds(500) < 8 * seconds(5)
