"""The stored keyword index against scoring all documents anew; the frequent n-grams against counting all."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import frequent, keyword, keyword_index, tfidf, vector_index, vectors
from quarry.operators.keyword_index import KeywordIndex
from quarry.plans import registry


def corpus_rows(seed: int, ids: range) -> list[tuple[int, str]]:
    """Documents of very different lengths over few words, a few of them rare; blank and null texts, and ties."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.6)) % 400}"
    rows = [(i, " ".join(word() for _ in range(rng.choice((3, 8, 30, 120))))) for i in ids]
    return rows + [(ids.stop, None), (ids.stop + 1, "  \n "), (ids.stop + 2, "The w7 w7"), (ids.stop + 3, "the w7 w7")]


QUERIES = [(1, "w7 w3"), (2, "the of"), (3, "w399 zebra"), (4, " "), (5, None), (6, "w1 w2 w3 w4 w5 w6 w8 w9 w10 w11 the"), (7, "w7 w7 w12")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)


def answers(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


def same(index, spark, rows, asked, k=5):
    want = answers(keyword.bm25_top(frame(spark, rows), asked, k))
    assert answers(index.search(asked, k)) == want and answers(index.search(asked, k, prune=True)) == want
    shape, terms = index.statistics()
    df = keyword.postings(frame(spark, rows)).groupBy("term").count()
    assert shape.head().n_docs == len(rows) and terms.head().n_terms == df.count() and terms.head().n_postings == df.agg(F.sum("count")).head()[0]


def test_updates_deletes_and_compaction(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "RANGE", 8)
    rows = dict(corpus_rows(1, range(200)))
    index = KeywordIndex.build(frame(spark, list(rows.items())), f"file://{tmp_path}/i", 4)
    same(index, spark, list(rows.items()), asked)
    change = {3: "w7 entirely new words", 7: "", 1000: "w399 and the zebra", 204: "of of of"}
    index.update(frame(spark, list(change.items())))
    rows |= change
    same(index, spark, list(rows.items()), asked)
    index.update(frame(spark, [(3, "w7 again"), (1001, "w3")]))  # a document changed twice
    rows |= {3: "w7 again", 1001: "w3"}
    index.delete(spark.createDataFrame([(1000,), (5,), (4711,)], "doc_id long"))
    rows = {i: t for i, t in rows.items() if i not in (1000, 5)}
    index.update(frame(spark, [(1000, "back with w7")]))  # one that was deleted comes back
    rows[1000] = "back with w7"
    same(index, spark, list(rows.items()), asked)
    before = answers(index.scores(asked).withColumn("rank", F.lit(0)))
    index.compact()
    assert len(index.manifest()) == 1
    same(index, spark, list(rows.items()), asked)
    assert answers(index.scores(asked).withColumn("rank", F.lit(0))) == before


def test_a_writer_that_dies_leaves_no_trace(spark, asked, tmp_path, monkeypatch):
    rows = dict(corpus_rows(2, range(60)))
    index = KeywordIndex.build(frame(spark, list(rows.items())), f"file://{tmp_path}/i", 2)
    before = answers(index.search(asked, 5))

    def dies(*_):
        raise OSError("no more room")

    with monkeypatch.context() as m:
        m.setattr(KeywordIndex, "_commit", dies)
        with pytest.raises(OSError):
            index.update(frame(spark, [(1, "w7 w7 w7"), (500, "w3")]))
    assert answers(index.search(asked, 5)) == before
    index.update(frame(spark, [(1, "w7 w7 w7"), (500, "w3")]))
    same(index, spark, list((rows | {1: "w7 w7 w7", 500: "w3"}).items()), asked)


def test_ranges_that_cannot_win_are_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "RANGE", 8)
    rng = random.Random(3)
    rows = [(i, " ".join(["x3"] * ((i % 300 == 0) * 15) + [f"x{rng.randrange(200)}" for _ in range(30 + i % 40)])) for i in range(1500)]
    index = KeywordIndex.build(frame(spark, rows, 2), f"file://{tmp_path}/i", 2)
    q = spark.createDataFrame([(1, "x3 zebra"), (2, "x3")], "query_id int, query string")
    parts, ranges, rest = index.pruned(q, 3)
    assert rest.count() < 0.5 * ranges.count() and parts.count() < 0.6 * index.parts(q).count()
    assert answers(index.search(q, 3, prune=True)) == answers(keyword.bm25_top(frame(spark, rows), q, 3))


def test_tasks_keep_the_best_of_their_groups(spark, tmp_path, monkeypatch):
    """What leaves a task are k documents for a query and group, and those that could be taken for filling; pruning, several blocks of queries and negative scores change no answer."""
    for name, value in (("RANGE", 8), ("GROUP", 2), ("QUERY_BLOCK", 3)):
        monkeypatch.setattr(keyword_index, name, value)
    rows = corpus_rows(9, range(200)) + [(-5, "w7 w3"), (-6, "the of and")]
    index = KeywordIndex.build(frame(spark, rows, 2), f"file://{tmp_path}/i", 2)
    assert 0 < index._read("postings", [0]).select("bucket", "term", "range").distinct().count() == index._read("postings", [0]).count()
    q = spark.createDataFrame([(i, f"w{i} w{i % 5} the" if i % 2 else f"w{i % 7}") for i in range(30)], "query_id int, query string")
    groups = index._read("docs", [0]).select(F.floor(F.col("range") / 2)).distinct().count()
    best = index.best(q, 3, index.manifest(), -100)
    assert groups > 9 and best.groupBy("query_id").count().agg(F.max("count")).head()[0] <= 3 * groups < len(rows)
    assert best.count() < index.scores(q).count()
    want = answers(keyword.bm25_top(frame(spark, rows), q, 3))
    assert answers(index.search(q, 3)) == want and answers(index.search(q, 3, prune=True)) == want
    few = rows[:1] + [(1, "a a b"), (2, "a"), (3, "a c"), (4, "a b"), (5, "a"), (6, "a")]  # words that most have: the mean idf is negative
    small = KeywordIndex.build(frame(spark, few), f"file://{tmp_path}/j", 2)
    q = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "b c")], "query_id int, query string")
    assert answers(small.search(q, 2)) == answers(keyword.bm25_top(frame(spark, few), q, 2))


def test_what_a_search_shuffles_does_not_grow_with_groups(spark, tmp_path, monkeypatch):
    """A task gives on k documents for a query, however many groups it meets; held in parts, beyond what is broadcast and with negative scores the answers are the same."""
    for name, value in (("RANGE", 4), ("GROUP", 1), ("QUERY_BLOCK", 7)):
        monkeypatch.setattr(keyword_index, name, value)
    rows = corpus_rows(9, range(400)) + [(-5, "w7 w3"), (-6, "the of and")]
    index = KeywordIndex.build(frame(spark, rows, 2), f"file://{tmp_path}/i", 2)
    q = spark.createDataFrame([(i, f"w{i} w{i % 5} the" if i % 2 else f"w{i % 7}") for i in range(30)], "query_id int, query string")
    groups = index._read("docs", [0]).select("range").distinct().count()
    best = index.best(q, 3, index.manifest(), -100)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert best.groupBy("query_id").count().agg(F.max("count")).head()[0] <= 3 * parts < groups
    want = answers(keyword.bm25_top(frame(spark, rows), q, 3))
    assert answers(index.search(q, 3)) == want
    for chars, held in ((0, 1 << 21), (0, 90), (1 << 20, 40)):  # paired by Spark, with several partitions of queries, and given on again and again
        monkeypatch.setattr(keyword_index, "BROADCAST_CHARS", chars)
        monkeypatch.setattr(keyword_index, "HELD", held)
        assert answers(index.search(q, 3)) == want and answers(index.search(q, 3, prune=True)) == want
    monkeypatch.setattr(keyword_index, "FEW_CHARS", 0)  # groups of stored documents
    for chars in (0, 1 << 20):
        monkeypatch.setattr(keyword_index, "BROADCAST_CHARS", chars)
        assert answers(index.search(q, 3)) == want
    assert not any("/postings/" in f for f in index.best(q, 3, index.manifest(), -100).inputFiles())
    few = rows[:1] + [(1, "a a b"), (2, "a"), (3, "a c"), (4, "a b"), (5, "a"), (6, "a")]
    small = KeywordIndex.build(frame(spark, few), f"file://{tmp_path}/j", 2)
    q = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "b c")], "query_id int, query string")
    assert answers(small.search(q, 2)) == answers(keyword.bm25_top(frame(spark, few), q, 2))


def test_excerpts_are_cut_before_they_meet_conversations(spark, sf):
    plan = registry.QUERIES["chat_context_batch"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    join = next(i for i, x in enumerate(lines) if "Join Inner, (doc_id" in x or ("Join Inner" in x and "doc_id" in x))
    cut = next(i for i, x in enumerate(lines) if "substring(text" in x)
    assert cut > join


def test_an_update_writes_its_share(spark, tmp_path):
    rows = corpus_rows(4, range(2000))
    index = KeywordIndex.build(frame(spark, rows), f"file://{tmp_path}/i", 4)
    index.update(frame(spark, [(i, "w7 w3 w5") for i in range(20)]))
    count = lambda name, seg: index._read(name, [seg]).count()
    assert count("docs", 1) == 20 == count("dead", 1) and count("postings", 1) <= 60
    assert count("terms", 1) <= index._read("docs", [0]).filter("doc_id < 20").select(F.explode("terms")).distinct().count() + 3


def test_searches_read_no_documents(spark, sf):
    for name in ("bm25_topk", "bm25_pruned", "hybrid_weighted"):
        assert not any("documents" in f for f in registry.QUERIES[name](spark, sf).inputFiles())


def test_an_empty_index(spark, asked, tmp_path):
    index = KeywordIndex.build(frame(spark, []), f"file://{tmp_path}/i", 2)
    assert index.search(asked, 3).count() == 0 and index.search(asked, 3, prune=True).count() == 0
    index.update(frame(spark, [(1, "w7"), (2, "x"), (3, "y")]))
    assert [r.doc_id for r in index.search(asked.filter("query_id = 1"), 1).collect()] == [1]


# frequent n-grams


def plain_counts(rows, most):
    total, df = collections.Counter(), collections.Counter()
    for _, t in rows:
        w = [x for x in (t or "").lower().split() if len(x) > 1 and x not in keyword.STOP_WORDS]
        g = [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]
        total.update(g)
        df.update(set(g))
    return total, df


@pytest.mark.parametrize("top,held,sent,gathered,bounds", [(50, 1 << 20, 1 << 16, 1 << 22, (1, 1.0)), (20, 400, 300, 500, (1, 1.0)), (30, 500, 400, 700, (3, 0.5)), (100_000, 1 << 20, 1 << 16, 1 << 22, (2, 0.9))])
def test_frequent_ngrams(spark, monkeypatch, top, held, sent, gathered, bounds):
    """Exact whatever the room for counters, with bounds on documents and ties by term."""
    for name, value in (("HELD", held), ("SENT", sent), ("GATHERED", gathered)):
        monkeypatch.setattr(frequent, name, value)
    rows = corpus_rows(5, range(300))
    total, df = plain_counts(rows, 3)
    lo, hi = bounds
    want = sorted((g for g in total if lo <= df[g] <= hi * len(rows)), key=lambda g: (-total[g], g))[:top]
    found = frequent.most_frequent(frame(spark, rows), "doc_id", "text", top, 3, *bounds)
    if held > 1000 or bounds == (1, 1.0):
        assert found is not None
    got = tfidf.vocabulary(frame(spark, rows), top, 3, *bounds).collect()
    assert {r.term: (r.total, r.df) for r in got} == {g: (total[g], df[g]) for g in want}


def test_summaries_are_short_by_their_error_at_most():
    rng = np.random.default_rng(1)
    keys = rng.zipf(1.3, 20_000).astype(np.uint64)
    s = frequent.Summary(64)
    for part in np.split(keys, 20):
        s.add(part)
    true = dict(zip(*np.unique(keys, return_counts=True), strict=True))
    held = dict(zip(s.key.tolist(), s.count.tolist(), strict=True))
    assert len(held) <= 64 and s.error <= len(keys) / 64
    assert all(true[k] - s.error <= held.get(int(k), 0) <= true[k] for k in true)


def test_tfidf_by_candidates_and_by_counting_all(spark, monkeypatch):
    rows, q = corpus_rows(6, range(120)), spark.createDataFrame(QUERIES, "query_id int, query string")
    one = sorted(map(tuple, tfidf.tfidf_scores(frame(spark, rows), q, 60).collect()))
    monkeypatch.setattr(frequent, "most_frequent", lambda *_: None)
    other = sorted(map(tuple, tfidf.tfidf_scores(frame(spark, rows), q, 60).collect()))
    assert len(one) > 50 and [r[:2] for r in one] == [r[:2] for r in other] and np.allclose([r[2] for r in one], [r[2] for r in other], atol=2e-6)


# vectors


def points(seed: int, n: int, dims: int = 16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    x = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, dims)) * 0.4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * dims), (n + 2, x[3].tolist())]
    return rows


VECTOR = "vec_id long, embedding array<double>"


def test_vector_cells(spark, tmp_path, monkeypatch):
    """Every row is in a cell; probes find nine of ten, bounds find all, also after additions and with a cell that holds most rows."""
    monkeypatch.setattr(vector_index, "CELL_ROWS", 50)
    rows = points(1, 2000)
    rows += [(5000 + i, rows[7][1]) for i in range(600)]  # one cell holds a quarter
    index = vector_index.VectorIndex.build(spark.createDataFrame(rows[:2300], VECTOR).repartition(3), f"file://{tmp_path}/v", 40)
    index.add(spark.createDataFrame(rows[2300:], VECTOR))
    assert sum(r["n"] for r in index._cells()) == len(rows) - 2
    every = spark.createDataFrame(rows, VECTOR)
    q = every.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    want = {(r.query_id, r.rank): (r.vec_id, r.similarity) for r in vectors.cosine_top(q, every, 10).collect()}
    exact = {(r.query_id, r.rank): (r.vec_id, r.similarity) for r in index.search(q, 10, probes=2, exact=True).collect()}
    assert exact == want
    assert index._cells()[0]["probes"] < 20  # vectors that lie in groups need few
    found = {(r.query_id, r.vec_id) for r in index.search(q, 10).collect()}
    assert sum((i, v) in found for (i, _), (v, _) in want.items()) >= 0.9 * len(want)
    few = index.search(spark.createDataFrame(rows[:1], VECTOR).withColumnRenamed("vec_id", "query_id"), 3, probes=2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    (read,) = re.findall(r"PartitionFilters: \[[^]]*cell#\d+ IN \(([\d,]+)\)", plan)
    assert len(read.split(",")) == 2  # only the partitions of these cells are read


def test_vector_index_of_nothing(spark, tmp_path):
    index = vector_index.VectorIndex.build(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], VECTOR), f"file://{tmp_path}/v")
    assert index.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>"), 3, exact=True).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_recall_of_probes(spark, sf, size):
    sf = sf.replace("0.001", size)
    want = {(r.query_id, r.vec_id) for r in registry.QUERIES["vector_topk"](spark, sf).collect()}
    got = {(r.query_id, r.vec_id) for r in registry.QUERIES["vector_probed"](spark, sf).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_words_are_counted_as_spark_splits_them(spark, monkeypatch):
    """Slices of a few bytes, white space of every kind (and what is none in Java), blank and null texts."""
    monkeypatch.setattr(keyword_index, "SLICE_BYTES", 8)
    texts = ["a\x0bb  B c\x1cd ", "\t\n", None, "", "Ä ä x \x0c\r y", "a a a", "x" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.dl, dict(zip(r.terms, r.tfs, strict=True))) for r in KeywordIndex._rows(rows).collect()}
    w = rows.select("doc_id", keyword.tokens(F.col("text")).alias("w")).collect()
    assert got == {r.doc_id: (len(r.w), dict(collections.Counter(r.w))) for r in w}


def test_found_rows_are_broadcast_to_the_documents(spark, sf):
    """What was found moves to the documents, not the documents to it, though these are too large to be broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        plan = registry.QUERIES["prompt_build"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    joins = [x for x in plan.split("\n") if "Join" in x and "doc_id" in x]
    assert joins and all("BroadcastHashJoin" in x and "BuildLeft" in x for x in joins)


@pytest.mark.parametrize("most,held", [(1 << 20, 40), (0, 1 << 22)])
def test_pairs_are_scored_in_tasks(spark, monkeypatch, most, held):
    """Scores of the pairs by tasks that hold few sums, and by joined terms, against sums of joined weights; no exchange of pairs."""
    monkeypatch.setattr(tfidf, "MOST_ASKED", most)
    monkeypatch.setattr(tfidf, "HELD", held)
    rng = random.Random(7)
    docs = [(i, " ".join(f"word{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.choice((0, 4, 40)))), 10 * i) for i in range(60)]
    corpus = spark.createDataFrame(docs, "doc_id long, text string, size int").repartition(3)
    asked = spark.createDataFrame([(i, f"word{i} word{i + 1} word{2 * i}") for i in range(9)], "query_id int, query string")
    found = tfidf.tfidf_scores(corpus, asked, 200, 2, carry="size")
    vocab = tfidf.counted_vocabulary(tfidf.with_grams(corpus, "doc_id", "text", 2), 200)
    side = lambda df, key, text: tfidf.weights(tfidf.gram_rows(tfidf.with_grams(df, key, text, 2), key, vocab), vocab, key)
    want = side(asked, "query_id", "query").withColumnRenamed("w", "qw").join(side(corpus, "doc_id", "text"), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("s"))
    want = {(r.query_id, r.doc_id): r.s for r in want.collect()}
    got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-6)
    assert all(r.size == 10 * r.doc_id for r in found.collect())
    if most:
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
