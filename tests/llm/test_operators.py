"""The ten operators against plain versions, on a fixture with nulls, empty and long texts, copies, passages and odd columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, fingerprints, mixing, ngram_join, packing, passage_dedup, quality_classifier, quality_rules, queries, suffix_dedup, token_counts, token_files, tokens, work

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, row string, votes int"


def texts() -> list[str | None]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, base = prose(70), prose(200)
    near = [" ".join(x if rng.random() > 0.004 else word() for x in base.split()) for _ in range(12)]
    out = [None, "", " \n\t ", "one", "two words", base, base, *near, "x" * 130, prose(20) + "\n" + passage, prose(15) + " " + passage + " " + prose(9), "The same line.\n" * 40, "日本語 テキスト 日本語", prose(3000), "a  b\n\n c\t d e <|endoftext|> it's 12", prose(49), prose(120)]
    return out + [prose(rng.randint(30, 120)) for _ in range(25)]


@pytest.fixture(scope="module")
def docs(spark):
    work.small_batches(spark)
    rows = [(i * 3, t, "en", ["s1", "s0", None][i % 3] if i % 4 else "s1", 0, "w", "row", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    return text.encode().split()


def test_fingerprints(docs, plain):
    got = by_id(fingerprints.fingerprint_edits(docs))
    for (i, t), (_, u) in zip(plain, plain[1:] + plain[:1]):
        h = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[15].fingerprint == got[18].fingerprint and got[15].near_next == 1.0
    assert got[21].near_next > 0.5 > got[plain[-3][0]].near_next


def sets(plain, k):
    out = {}
    for i, t in plain:
        w = t.encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


@pytest.mark.parametrize("k,percent,leaders,cell", [(3, 90, 3, 1024), (3, 90, 1, 2), (5, 80, 1, 3), (1, 50, 1, 2), (1, 50, 3, 1024)])
def test_ngram_join(docs, plain, k, percent, leaders, cell, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    monkeypatch.setattr(ngram_join, "CELL", cell)
    own = sets(plain, k)
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in own:
        for b in own:
            if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    documents, links = ngram_join.ngram_join(docs, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in documents.collect()} == {i: (len(own[i]), find(i)) for i in own}
    assert all(100 * len(own[r.a] & own[r.b]) >= percent * len(own[r.a] | own[r.b]) for r in links.collect())


def test_one_bit_minhashes():
    """Unrelated sets are told apart, linked ones never are."""
    rng = np.random.default_rng(4)
    most, unlike = ngram_join.most_apart(80), 0
    for n in [*[7, 20, 100, 700] * 50, 5000]:
        x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        d = n // 9  # 80 % of the union is common
        a, b, c = x[:n], np.r_[x[d:n], x[n : n + d]], x[n:]
        apart = lambda u, v: int(np.bitwise_count(ngram_join.one_bit(u) ^ ngram_join.one_bit(v)).sum())
        assert apart(a, b) <= most
        unlike += apart(a, c) > most
    assert unlike >= 190 and ngram_join.most_apart(90) < most < 64


def test_ngram_join_of_a_repeated_id(spark):
    """Rows that share a doc_id are nodes by their texts."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, "some other text of its own"), (2, " ".join(words[:58] + ["x", "y"])), (3, "some other text of its own"), (4, None)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)[0]
    assert sorted((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in got.collect()) == [(1, 4, 1, 1), (1, 58, 1, 1), (2, 58, 2, 1), (3, 4, 1, 1), (4, 0, 4, 4)]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (200, 200)], "a long, b long")
    assert {r.node: r.root for r in components.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100, 200: 200}


def encoded(plain, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    return {i: np.array(t.encode(x, add_special_tokens=False).ids + [end], "<u4") for i, x in plain}


def test_packing(docs, plain):
    ids = encoded(plain, "word_bpe_49k.json", 1)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"), 1).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(pieces[i], len(ids[i])) for i in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 2048
    assert sum(len(x) for x in ids.values()) > 0.9 * 2048 * (len(sequences) - 1)


def test_cutting_stock():
    rng = random.Random(2)
    demand = collections.Counter(rng.randint(1, 256) for _ in range(100_000))
    patterns = packing.cutting_stock(demand)
    held = collections.Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= 256
        for k, n in pattern.items():
            held[k] += n * times
    assert held == demand
    assert sum(t for _, t in patterns) <= 1.01 * sum(k * n for k, n in demand.items()) / 256 + 1
    assert packing.cutting_stock({}) == []


@pytest.mark.parametrize("length", [50, 20])
def test_suffix_dedup(docs, plain, length):
    got, seen = by_id(suffix_dedup.repeated_substrings(docs, length)), set()
    for i, x in plain:
        t = x.encode()
        flags = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if t[j : j + length] in seen:
                flags[j : j + length] = b"\1" * length
        seen |= {t[j : j + length] for j in range(len(t) - length + 1)}
        kept = bytes(b for b, c in zip(t, flags) if not c)
        n_spans = sum(1 for j in range(len(t)) if flags[j] and (not j or not flags[j - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(flags), n_spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_sort():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    start, segment = rng.integers(0, 2900, 400), rng.integers(0, 5, 400)
    order = suffix_dedup.sort_suffixes(buf, suffix_dedup.blocks.prefix_hashes(buf), start, segment, 50)
    assert order.tolist() == sorted(range(400), key=lambda i: (segment[i], buf[start[i] : start[i] + 50].tobytes(), i))


def test_token_files(spark, docs, plain, tmp_path):
    ids = encoded(plain, "byte_bpe_50k.json", 0)
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, path, tokens.vocabulary("byte_bpe_50k.json"), 0, spaced=True, chunk_ids=500)
    got = by_id(token_files.read_token_files(spark, path, with_ids=True))
    at = 0
    for i, _ in plain:
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, bytes(got[i].ids)) == (at, len(ids[i]), zlib.crc32(ids[i].tobytes()), ids[i].tobytes())
        at += len(ids[i])


def test_simple8b():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [2**40, 1, 2**31], *(rng.integers(0, 2**b, n) for b in (1, 4, 17, 33) for n in (1, 511, 512, 513, 5000))):
        ids = np.array(ids, np.uint64)
        coded, per_block = token_files.encode(ids)
        assert per_block.sum() == len(coded) and (token_files.decode(coded, len(ids)) == ids).all()
        for a, b in ((0, len(ids)), (3, 520), (600, 601), (len(ids) - 1, len(ids) + 9)):
            assert (token_files.decode_range(coded, per_block, len(ids), a, b) == ids[max(a, 0) : b]).all()


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(name, spaced):
    from quarry.llm import blocks
    import pyarrow as pa

    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", ".", "1", "'s", " ", "日本", "́", "###", "\x0b", "😀", "İ", "\x1c", "Σ", "\x00", "<|endoftext|>"]
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    want = encoded(list(enumerate(some)), name, 7)
    encoder, k = tokens.WordEncoder.of(tokens.vocabulary(name), spaced), 0
    for s in blocks.slices([pa.RecordBatch.from_arrays([pa.array(some)], names=["text"])], limit=3000):
        ids, n = encoder.encode_rows(s.buf, s.off, 7)
        for part in np.split(ids, np.cumsum(n)[:-1]):
            assert part.tolist() == want[k].tolist(), some[k]
            k += 1
    assert k == len(some)


def test_token_counts(docs):
    edits = token_counts.three_edits(F.col("text"), F.col("source"))
    got = by_id(token_counts.count_with_edits(docs, edits, tokens.vocabulary("byte_bpe_50k.json")))
    before, after = [], []
    for r in docs.select("doc_id", "text", edits.alias("e")).collect():
        t = u = r.text or ""
        for e in reversed(r.e or []):
            u = u[: e.begin] + e.text + u[e.end :]
        before.append((r.doc_id, t))
        after.append((r.doc_id, u))
    a, b = encoded(before, "byte_bpe_50k.json", 0), encoded(after, "byte_bpe_50k.json", 0)
    assert {i: (r.n_tokens, r.edited_tokens) for i, r in got.items()} == {i: (len(a[i]) - 1, len(b[i]) - 1) for i in a}
    special = {i for i, t in before + after if "<|" in t}
    assert max(r.n_recounted for i, r in got.items() if i not in special) < 60
    assert all(any(e.text or e.end > e.begin for e in r.e) for r in docs.select("text", edits.alias("e")).collect() if r.text)


def test_edit_that_makes_a_special_token():
    """A token that an edit puts together out of its parts, and one that it takes apart."""
    encoder = tokens.WordEncoder.of(tokens.vocabulary("byte_bpe_50k.json"), True)
    for text, a, b, new in (("one  two   <|endof|> three", 17, 17, "text"), ("one  <|endoftext|>  two", 9, 11, ""), ("a  b", 3, 3, "<|endoftext|>")):
        tree = token_counts.PieceTree(text.encode(), encoder)
        tree.edit(a, b, new.encode())
        assert tree.tokens == len(encoder.tokenizer.encode(text[:a] + new + text[b:], add_special_tokens=False).ids)


def test_passages(docs, plain):
    got, first = by_id(passage_dedup.repeated_passages(docs, whole=True)), {}
    for i, t in plain:
        w = t.encode().lower().split()
        removed = set()
        for a, b in zip(got[i].spans[::2], got[i].spans[1::2]):
            removed |= set(range(a, b))
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                assert set(range(j, j + 50)) <= removed
        assert got[i].n_words == len(w) and got[i].n_removed == len(removed) and got[i].row.w == "w"
        if not removed:
            assert got[i].text == t
    assert got[18].text == "" and all(got[21 + 3 * k].n_removed > 150 for k in range(12))


def test_chain_of_moved_fragments():
    at = np.r_[np.arange(0, 40, 4), np.arange(60, 100, 4)]
    both = passage_dedup.chains(at, np.r_[at[:10] + 500, at[10:] + 507])
    assert [len(c) for c in both] == [2]
    assert len(passage_dedup.chains(at, np.r_[at[:10] + 500, at[10:] + 200])) == 2


@pytest.mark.parametrize("apart", [30, 60, 100])
def test_two_passages_in_one_chain(spark, apart):
    rng = random.Random(apart)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    a, b = own(60), own(60)
    rows = [own(20) + a + own(apart) + b + own(20), own(30) + a + own(apart) + b + own(10)]
    got = by_id(passage_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")))
    assert got[0].spans == [] and got[1].spans == [30, 90, 90 + apart, 150 + apart]


def test_passage_with_a_poor_tail():
    m = np.r_[np.ones(50, bool), np.tile(np.arange(10) < 7, 40)]
    (x, y), *_ = passage_dedup.stretches(m)
    assert x == 0 and y >= 50 and m[x:y].mean() >= 0.8
    rng = np.random.default_rng(3)
    for p in (0.6, 0.8, 0.9):
        m = rng.random(400) < p
        assert all(y - x >= 50 for x, y in passage_dedup.stretches(m))
    assert passage_dedup.stretches(np.tile(np.arange(5) < 4, 12)) == [(0, 59)]


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_passage_of_frequent_lines(spark, partitions):
    """Each line of the passage also stands alone in other documents, which its seeds meet before the document that has the passage."""
    rng = random.Random(4)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    lines = [own(12) for _ in range(6)]
    pairs = [[*own(30), *x, *own(30), *y, *own(30)] for x, y in zip(lines, lines[2:] + lines[:2])]
    joined = [own(8) + [w for x in lines for w in x] + own(9) for _ in range(2)]
    texts = [*pairs, joined[0], *[[*own(20), *x, *own(20)] for x in lines], joined[1]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(partitions)
    got, first = by_id(passage_dedup.repeated_passages(docs)), {}
    for i, w in enumerate(texts):
        want = set()
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                want |= set(range(j, j + 50))
        assert {k for a, b in zip(got[i].spans[::2], got[i].spans[1::2]) for k in range(a, b)} == want
    assert got[13].spans == [8, 80] and got[13].first_docs == [6]


@pytest.mark.parametrize("before, after, partitions", [(1, 1, 1), (1, 1, 7), (40, 40, 3), (1, 80, 3)])
def test_near_passage_of_a_document_in_between(spark, before, after, partitions):
    """All seeds of a near passage stand in earlier and in later documents too, up to frequent ones, so that neither a seed's first document nor the one before has the passage."""
    rng = random.Random(before)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(72)
    alone = lambda: [own(25) + passage[a : a + 13] + own(25) for a in range(0, 72, 6)]
    again = [own(1)[0] if j % 12 == 11 else w for j, w in enumerate(passage)]
    texts = [w for _ in range(before) for w in alone()] + [own(30) + passage + own(30)] + [w for _ in range(after) for w in alone()] + [own(20) + again + own(20)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(partitions)
    got = by_id(passage_dedup.repeated_passages(docs))
    last = len(texts) - 1
    assert all(r.n_removed == 0 for i, r in got.items() if i != last) and len(got) == len(texts)
    assert got[last].first_docs == [12 * before] and got[last].spans == [20, 91]


@pytest.mark.parametrize("percent", [85, 90, 95])
def test_recall_of_near_passages(spark, percent):
    """Passages in which so many words agree are found in nine of ten cases, and no other word goes."""
    rng = random.Random(percent)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, place = [], {}
    for k in range(60):
        n = (60, 120, 240)[k % 3]
        passage, before = own(n), own(rng.randint(10, 60))
        other = set(rng.sample(range(n), n * (100 - percent) // 100))
        again = [own(1)[0] if j in other else w for j, w in enumerate(passage)]
        rows += [own(40) + passage + own(40), before + again + own(40)]
        place[2 * k + 1] = (len(before), len(before) + n)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(3)
    got, found = by_id(passage_dedup.repeated_passages(docs)), 0
    for i in range(len(rows)):
        removed = {k for a, b in zip(got[i].spans[::2], got[i].spans[1::2]) for k in range(a, b)}
        a, b = place.get(i, (0, 0))
        assert removed <= set(range(a, b))
        found += i in place and len(removed) >= 0.75 * (b - a)
    assert found >= 0.9 * len(place), found


def test_mixing(docs, plain):
    got = by_id(mixing.mix(docs))
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(words(t)) for i, t in plain}
    by = collections.Counter()
    for i, n in size.items():
        by[source[i]] += n
        assert got[i].size == n and 0 <= got[i].taken <= 2 * n
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = dict(zip(order, (3, 1, 2)))
    target, full, left = {}, set(), 1.5 * sum(by.values())
    while True:
        level = left / sum(weight[s] for s in order if s not in full)
        over = [s for s in order if s not in full and level * weight[s] > 2 * by[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            target[s] = 2 * by[s]
            left -= 2 * by[s]
    target |= {s: level * weight[s] for s in order if s not in full}
    for s in order:
        mine = [got[i] for i in size if source[i] == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == by[s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    rows = mixing.mix_documents(docs, 4).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.row.doc_id] += len(words(r.row.text))
    assert {i: r.taken for i, r in got.items() if r.taken} == dict(taken) and {r.shard for r in rows} <= set(range(4))


def test_mixing_counts_what_is_drawn(spark, sf, docs, monkeypatch):
    columns = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    for d in (docs, docs.union(docs.filter("doc_id in (6, 15, 60, 72)"))):
        assert sorted(mixing.mix_counts(d, 4).collect()) == sorted(mixing.mix(d).select(*columns).collect())
    calls, draws = [], mixing.shard_draws
    monkeypatch.setattr(mixing, "shard_draws", lambda *a: calls.append(1) or draws(*a))
    assert queries.QUERIES["op9_mixing"](spark, sf).columns == columns and calls


def test_shards_have_even_partitions(spark):
    rows = spark.range(20_000).select((F.col("id") % 16).cast("int").alias("shard"), F.xxhash64("id").alias("place"))
    per = mixing.in_shards(rows, 16, 51).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("shard").alias("s")).collect()
    assert len(per) == 64 and max(r.n for r in per) < 1.25 * 20_000 / 64 and {r.s for r in per} == {1}


def test_splitting_tree():
    q = np.array([100, 7, 0, 33])
    table = mixing.split_quotas(q, 5, np.random.default_rng(0))
    assert (table.sum(axis=0) == q).all() and np.ptp(table.sum(axis=1)) <= 2


def test_quality_rules(docs, plain):
    got = by_id(quality_rules.judge(docs, whole=True))
    for i, t in plain:
        w = [x.decode() for x in words(t)]
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        many = collections.Counter(windows)
        repeat = {p for j, x in enumerate(windows) if many[x] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)
        assert r.row.w == "w"
    assert got[15].kept


def test_weak_supervision_finds_noise(spark, sf):
    kept = queries.QUERIES["op10_quality_rules"](spark, sf.replace("0.001", "0.01")).join(spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").filter("not base_failed")
    good, bad = (kept.filter(f"quality = {q}") for q in (1, 0))
    assert good.filter("kept").count() >= 0.97 * good.count() and bad.filter("kept").count() <= 0.1 * bad.count()


def test_classifier(spark, sf, docs):
    out = queries.QUERIES["op5_quality_classifier"](spark, sf.replace("0.001", "0.01"))
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    held = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert (held["predicted"] == held["quality"]).mean() >= 0.95 and out.filter("score < 0 or score > 1").isEmpty()
    stats = work.written(quality_classifier.with_statistics(docs), "stats")
    none = quality_classifier.scored(stats, quality_classifier.fit(stats, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}


EMPTY = {
    "fingerprints": fingerprints.fingerprint_edits,
    "ngram_join": lambda d: ngram_join.ngram_join(d)[0],
    "packing": lambda d: packing.pack(d, tokens.vocabulary("word_bpe_49k.json"), 1),
    "suffix_dedup": suffix_dedup.repeated_substrings,
    "classifier": lambda d: quality_classifier.scored(quality_classifier.with_statistics(d), quality_classifier.Model([0.0] * quality_classifier.N_STATS, [1.0] * quality_classifier.N_STATS)),
    "token_counts": lambda d: token_counts.count_with_edits(d, F.lit(None).cast("array<struct<begin:int,end:int,text:string>>"), tokens.vocabulary("byte_bpe_50k.json")),
    "passages": passage_dedup.repeated_passages,
    "mixing": mixing.mix_documents,
    "quality_rules": quality_rules.judge,
}


@pytest.mark.parametrize("name", list(EMPTY))
def test_empty_table(spark, docs, name):
    assert EMPTY[name](docs.limit(0)).count() == 0


def test_empty_token_files(spark, docs, tmp_path):
    token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/f", tokens.vocabulary("byte_bpe_50k.json"), 0, spaced=True)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/f").count() == 0


@pytest.mark.parametrize("name", ["fingerprints", "suffix_dedup", "passages", "quality_rules", "token_counts", "packing"])
def test_repeated_rows(docs, name):
    """A row that occurs twice is answered twice, alike."""
    once = docs.filter("doc_id in (6, 15, 60, 72)")
    keep = {"fingerprints": ["doc_id", "n_chars", "fingerprint"], "packing": ["doc_id", "start", "length", "ids_crc32"]}.get(name)
    a, b = EMPTY[name](once), EMPTY[name](once.union(once))
    a, b = (x.select(*keep) if keep else x for x in (a, b))
    drop = [c for c in ("p_good", "kept") if c in a.columns]
    assert sorted(map(repr, b.drop(*drop).collect())) == sorted(2 * list(map(repr, a.drop(*drop).collect())))
