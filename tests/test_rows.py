"""Sources, sinks and small operators that no query has: fallbacks, databases, result files, logs, images, crawls, running counts."""

import json
import zlib

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.prompts import NO_ANSWER, synthesis
from quarry.operators import crawl, fusion, pdf_blocks, vectors
from quarry.plans import retrieval
from quarry.sources import readers, sinks
from quarry.streaming import events as stream


def test_fallback_for_queries_without_results(spark):
    first = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, item string")
    second = spark.createDataFrame([(1, "c"), (2, "d"), (3, "e")], "query_id int, item string")
    assert sorted(map(tuple, readers.with_fallback(first, second).collect())) == [(1, "a"), (1, "b"), (2, "d"), (3, "e")]
    assert readers.with_fallback(first.limit(0), second).count() == 3  # the search that failed altogether
    good = spark.createDataFrame([(1, "x", 9.0)], "query_id int, item string, relevance_score double")
    web = fusion.with_web(good, spark.createDataFrame([(1, "w"), (2, "v")], "query_id int, item string"), spark.createDataFrame([(1,), (2,)], "query_id int"))
    assert sorted((r.query_id, r.item, r.relevance_score, r.source_type) for r in web.collect()) == [(1, "w", 8.0, "web"), (1, "x", 9.0, "document"), (2, "v", 8.0, "web")]


def test_migration_between_databases(spark, tmp_path):
    """A table read in ranges of its key, vectors decoded from JSON text, written to another database and read back alike."""
    spark._jvm.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    old, new = f"jdbc:derby:{tmp_path}/old;create=true", f"jdbc:derby:{tmp_path}/new;create=true"
    rows = [(i, f"title {i}", json.dumps([i / 2, 1.0])) for i in range(57)] + [(57, "", ""), (58, "x", "no vector")]
    spark.createDataFrame(rows, "id long, title string, embedding string").write.option("createTableColumnTypes", "title VARCHAR(80), embedding VARCHAR(200)").jdbc(old, "docs")
    read = readers.read_jdbc(spark, old, "docs", "ID", 0, 60, 4)
    assert read.rdd.getNumPartitions() == 4
    moved = readers.decode_vectors(read.withColumnsRenamed({c: c.lower() for c in read.columns}), "embedding")
    assert {r.id: (r.title, r.embedding) for r in moved.collect()} == {i: (t, json.loads(e) if e and e.startswith("[") else None) for i, t, e in rows}
    moved.withColumn("embedding", F.coalesce(F.to_json("embedding"), F.lit("none"))).write.option("createTableColumnTypes", "title VARCHAR(80), embedding VARCHAR(200)").option("batchsize", 10).jdbc(new, "docs")
    back = readers.read_jdbc(spark, new, "docs", "ID", 0, 60, 2)
    assert back.count() == 59 and back.filter("EMBEDDING = 'none'").count() == 2


def test_result_files(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "one\ntwo"), (2, "three")], "doc_id long, chunk string")
    for _ in range(2):  # a second run replaces the first
        sinks.write_results(chunks, f"{tmp_path}/r")
    back = spark.read.json(f"{tmp_path}/r/json")
    assert sorted((r.doc_id, r.chunk) for r in back.collect()) == [(1, "one\ntwo"), (2, "three")]
    text = "".join(f.read_text() for f in sorted((tmp_path / "r" / "txt").glob("part-*")))
    assert sorted(p.strip() for p in text.split("=" * 80) if p.strip()) == ["one\ntwo", "three"]


def test_processing_log(spark, tmp_path):
    runs = [(0, 2_500_000, 3, 40, None), (10, 1_000_010, 0, 0, "e" * 1500)]
    for r in runs:  # one row for each run is added
        sinks.log_row(spark.createDataFrame([r], "started_us long, finished_us long, chunks int, tokens int, error string"), "embed").write.mode("append").parquet(f"{tmp_path}/log")
    got = sorted((r.status, r.seconds, r.chunks, r.tokens, len(r.error or "")) for r in spark.read.parquet(f"{tmp_path}/log").collect())
    assert got == [("completed", 2.5, 3, 40, 0), ("failed", 1.0, 0, 0, 1000)]


def test_images_of_a_chunk(spark):
    chunks = spark.createDataFrame([(1, "a", [1, 2]), (1, "b", [2, 2, 3]), (2, "c", [1]), (2, "d", None)], "doc_id int, chunk_id string, pages array<int>")
    images = spark.createDataFrame([(1, 2, "i"), (1, 3, "j"), (1, 9, "k"), (2, 1, "l")], "doc_id int, page int, image_id string")
    assert sorted(map(tuple, pdf_blocks.attach_images(chunks, images).collect())) == [("a", "i"), ("b", "i"), ("b", "j"), ("c", "l")]


def test_crawl_stops_by_itself(spark, tmp_path):
    edges = [(i, i + 1) for i in range(12)] + [(12, 3), (5, 0), (40, 41)]
    e, seeds = spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(0,), (5,)], "page_id long")
    depth, frontier, k = {0: 0, 5: 0}, [0, 5], 0
    while frontier:
        k += 1
        frontier = sorted({b for a, b in edges if a in frontier} - set(depth))
        depth |= dict.fromkeys(frontier, k)
    got = {r.page_id: r.depth for r in crawl.crawled(seeds, e, f"file://{tmp_path}/c").collect()}
    assert got == depth == {r.page_id: r.depth for r in crawl.breadth_first(seeds, e, k).collect()}
    with pytest.raises(RuntimeError):
        crawl.crawled(seeds, e, f"file://{tmp_path}/d", most=2)


def test_running_document_frequencies(spark, tmp_path):
    docs = [(1, "a b b"), (2, "b c"), (3, None), (4, "A")]
    (tmp_path / "in").mkdir()
    query = stream.running_index(spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("df").outputMode("complete").start()
    try:
        for i, d in enumerate(docs):
            spark.createDataFrame([d], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/s{i}")
            for f in (tmp_path / f"s{i}").glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{i}.parquet")
            query.processAllAvailable()
        assert {r.term: r.df for r in spark.table("df").collect()} == {"a": 2, "b": 2, "c": 1}
    finally:
        query.stop()


def test_observed_stages(spark, sf):
    """Rows are counted as they pass through enhanced search."""
    watch = {s: Observation(s) for s in ("retrieved", "unique", "cut", "relevant")}
    rows = retrieval.enhanced(spark, sf, watch).collect()
    info = retrieval.pipeline_info(spark, sf).agg(F.sum("n_retrieved"), F.sum("n_unique"), F.sum("total_results")).head()
    assert (watch["retrieved"].get["rows"], watch["unique"].get["rows"], watch["relevant"].get["rows"]) == tuple(info) and watch["cut"].get["rows"] >= len(rows) == info[2]


def test_synthesis_without_anything_relevant(spark):
    q = spark.createDataFrame([(1, "what?"), (2, "why?")], "query_id int, query string")
    rows = spark.createDataFrame([(1, k, f"T{k}", "web" if k == 2 else "document", "x" * 400) for k in range(7, 0, -1)], "query_id int, place int, title string, source_type string, text string")
    got = {r.query_id: (r.answerable, r.prompt) for r in synthesis(q, rows).collect()}
    assert got[2] == (False, NO_ANSWER) and got[1][0]
    assert got[1][1].count("x" * 300) == 5 and "x" * 301 not in got[1][1] and "[2] T2 (web):" in got[1][1] and "T6" not in got[1][1]


def test_service_errors(spark):
    bodies = [('{"error": {"message": "max_tokens too large"}}', 400), ('{"error": {"message": "CUDA OUT OF MEMORY"}}', 500), ('{"error": "No such file: x"}', 404), ('{"error": {"message": "read Timeout"}}', 500), ('{"error": {"message": "odd"}}', 500), ("not json", 400), ("", 418), (None, 503)]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(bodies)], "i int, body string, status int").orderBy("i")
    got = [(r.e.kind, r.e.detail) for r in df.select(T.service_error(F.col("body"), F.col("status")).alias("e")).collect()]
    assert [k for k, _ in got] == ["context", "memory", "model", "timeout", "other", "bad request", "http 418", "unavailable"]
    assert got[4][1] == "odd" and got[5][1] == "not json"


def test_cosine_of_zero_and_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0) and got[2] is None


def test_hash_embedding_value_for_value(spark):
    texts = ["", None, "One two one", "é É naïve", "a " * 500, "x\ty\nz"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in vectors.hash_embedding(df, "t", 16).collect():
        words, v = (texts[r.i] or "").lower().split(), [0.0] * 16
        for w in words:
            h = zlib.crc32(w.encode())
            v[h % 16] += 1 if h >> 16 & 1 else -1
        norm = sum(x * x for x in v) ** 0.5
        assert r.embedding == (pytest.approx([x / norm if norm else x for x in v]) if words else None)


def test_crawl_by_words_makes_no_edges(spark):
    """The pages that all edges reach, where one word has most links and pages, without a join that has a row for each edge."""
    pages = spark.createDataFrame([(i, "common" if i % 3 else f"w{i % 40}") for i in range(300)] + [(900, None), (901, "alone")], "b long, w string")
    links = spark.createDataFrame([(i, "common" if i % 30 == 0 else f"w{(i * 7) % 50}") for i in range(300)] + [(1, None), (2, "alone")], "a long, w string")
    seeds = spark.createDataFrame([(0,), (3,)], "page_id long")
    edges = links.join(pages, "w").select("a", "b").distinct()
    want = {r.page_id: r.depth for r in crawl.breadth_first(seeds, edges, 2).collect()}
    df = crawl.by_words(seeds, links, pages, 2)
    assert {r.page_id: r.depth for r in df.collect()} == want and set(want.values()) == {0, 1, 2}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Join LeftSemi" in plan
