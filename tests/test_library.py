"""Operators without a query of their own, on small fixtures with worked-out results."""

import json


import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import html
from quarry.functions import text as T
from quarry.operators import chunking, fusion, pdf_blocks, vectors
from quarry.sources import readers, sinks
from quarry.streaming import events as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("text,want", [("x" * 2000, [(0, 2000)]), ("x" * 2001, [(0, 2000), (1850, 2001)]), ("x" * 4000, [(0, 2000), (1850, 3850), (3700, 4000)]), ("x" * 3850, [(0, 2000), (1850, 3850), (3700, 3850)])])
def test_chunk_offsets(text, want):
    assert list(chunking.spans(text)) == want


@pytest.mark.parametrize("mark,end,start", [("\n\n", 1500, 1350), (". ", 1501, 1351), ("! ", 2000, 1850)])
def test_chunk_boundaries(mark, end, start):
    (_, e), (s, _), *_ = chunking.spans("a" * 1500 + mark + "b" * 1500)
    assert (e, s) == (end, start)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab.\n! ", max_size=6000))
def test_chunks_cover(text):
    cut = list(chunking.spans(text, 500, 50))
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(b[0] <= a[1] for a, b in zip(cut, cut[1:]))


def test_fusion_sample(spark):
    words = spark.createDataFrame([(1, 1, 8.5), (1, 2, 6.2), (1, 3, 2.5)], "query_id int, doc_id int, score double").withColumn("rank", F.col("doc_id"))
    near = spark.createDataFrame([(1, 1, 0.92, 1), (1, 4, 0.85, 2), (1, 5, 0.78, 3)], "query_id int, doc_id int, similarity double, rank int")
    got = {r.doc_id: r.ensemble_score for r in fusion.weighted(words, near, 5).collect()}
    assert got[1] == pytest.approx(0.944) and got[4] == pytest.approx(0.595) and got[5] == pytest.approx(0.546)
    assert fusion.weighted(words, near, 5, normalize_vector=True).head().ensemble_score == 1.0
    rrf = [(r.doc_id, r.rrf_score) for r in fusion.reciprocal(words, near, 5).orderBy("rank").collect()]
    assert rrf == [(1, 0.032787), (2, 0.016129), (4, 0.016129), (3, 0.015873), (5, 0.015873)]


def test_rerank_only_where_many(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.1), (1, 2, 2, 0.9), (2, 3, 1, 0.1), (2, 4, 2, 0.9), (2, 5, 3, 0.5)], "query_id int, doc_id int, rank int, s double")
    got = [(r.query_id, r.doc_id) for r in fusion.rerank(df, F.col("s"), 2).orderBy("query_id", "final_rank").collect()]
    assert got == [(1, 1), (1, 2), (2, 4), (2, 5)]


def test_corrective_keeps_ungraded(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 2, 8.0), (2, 3, 2.0)], "query_id int, doc_id int, g double")
    assert sorted(r.doc_id for r in fusion.corrective(df, F.col("g")).collect()) == [1, 2]


def test_replies(spark):
    assert [one(spark, T.parse_relevance(F.lit(x))) for x in ("8/10", "12", "-1 x", "", "nan?")] == [8.0, 10.0, 0.0, 5.0, 5.0]
    assert one(spark, T.citations(F.lit("[2] [2] [Source 1] [9]"))) == ["2", "9", "1"]
    assert one(spark, T.invalid_citations(T.citations(F.lit("[2] [2] [Source 1] [9]")), F.lit(2))) == ["9"]
    assert one(spark, T.numbered_references(F.lit("yes [1]"), F.array(F.lit("A"), F.lit("B")))).endswith("## References\n[1] A")
    assert one(spark, T.expansions_of(F.lit("alpha beta. gamma delta"), 3)) == ["alpha beta. gamma delta"]


def test_tiers_and_names(spark):
    assert [one(spark, T.batch_size(F.lit(x))) for x in (8, 4, 2, 1, 0.5)] == [32, 16, 8, 4, 2]
    assert one(spark, T.progress_band(F.lit(0.5), 40.0, 95.0)) == 67.5
    assert one(spark, T.estimate_tokens(F.lit("abc"))) == 1
    assert one(spark, T.section_path(T.hierarchy(F.lit("A"), F.lit("A")), F.lit("1"))) == "A"
    assert one(spark, T.strong_password(F.lit("Abcdef1!"))) and not one(spark, T.strong_password(F.lit("abc")))
    long = one(spark, T.safe_file_name(F.lit("a/" + "x" * 300 + ".txt")))
    assert long == "x" * 250 + ".txt"


PAGE = """<html><head><title>T</title></head><body><nav>skip</nav><div class="menu">long menu text here</div>
<main><h1>Head</h1><p>First paragraph text.</p><h2>Empty</h2><h2>Code</h2><pre>print('hello world')</pre>
<table><tr><th>a</th><th>b</th></tr><tr><td>one cell</td><td>two</td></tr></table></main><footer>never this text</footer></body></html>"""


def test_html_sections():
    got = html.sections("http://x/y", PAGE)
    assert [(s["title"], s["level"], s["section_id"]) for s in got] == [("Head", 1, 2), ("Code", 2, 4)]
    assert got[1]["content"] == "Code example:\nprint('hello world')\n\nTable:\na | b\none cell | two"
    assert html.page_title(html.Tree("<p>x").root, "http://h.de/a/my-page_x") == "My Page X"
    assert html.sections("", "") == []


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"text": "a long enough text of words", "filepath": "d/f.c"}) + "\nnot json\n")
    (tmp_path / "b.json").write_text(json.dumps([{"text": "another long enough text"}, {"text": "short"}]))
    got = sorted((r.title, r.content) for r in readers.read_json_documents(spark, str(tmp_path)).collect())
    assert got == [("Section 1", "another long enough text"), ("f.c", "a long enough text of words")]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x.html").write_text("<p>é</p>")
    assert [r.html for r in readers.read_html(spark, str(tmp_path / "h")).collect()] == ["<p>é</p>"]
    v = spark.createDataFrame([("[1, 2.5]",), ("x",)], "v string")
    assert [r.v for r in readers.decode_vectors(v, "v").collect()] == [[1.0, 2.5], None]
    urls = spark.createDataFrame([("http://a/x/1",), ("http://a/y",)], "url string")
    assert [r.url for r in readers.allowed_by_robots(urls, spark.createDataFrame([("a", "/x")], "host string, prefix string")).collect()] == ["http://a/y"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    sinks.save_index(docs, f"{tmp_path}/i")
    index = sinks.extend_index(spark.createDataFrame([(2, "d"), (3, "e e")], "doc_id long, text string"), f"{tmp_path}/i")
    got = {(r.doc_id, r.term): r.tf for r in index.postings().collect()}
    assert got == {(1, "a"): 1, (1, "b"): 1, (2, "d"): 1, (3, "e"): 2}
    assert sinks.insert_missing(docs, docs.limit(1), "doc_id").count() == 2 and sinks.upsert(docs, docs, "doc_id").count() == 2
    assert "p" in sinks.add_column(docs, "p", "double", 0.0).columns


def test_pdf(spark):
    rows = [(1, 1, 0, "Chapter One", 20.0), (1, 1, 1, "word " * 60, 10.0), (1, 1, 2, "- an item of a list", 10.0), (1, 1, 3, "key    value", 10.0), (1, 2, 0, "Chapter Two", 20.0), (1, 2, 1, "few words only", 10.0)]
    blocks = pdf_blocks.typed(spark.createDataFrame(rows, "doc_id long, page int, ordinal int, text string, font_size double"))
    assert [r.kind for r in blocks.orderBy("page", "ordinal").collect()] == ["heading", "paragraph", "list_item", "table_row", "heading", "paragraph"]
    assert [(r.title, r.words > 60) for r in pdf_blocks.chunks(blocks).collect()] == [("Chapter One", True)]
    assert pdf_blocks.chunks(blocks, keep_short=True).count() == 2
    tables = spark.createDataFrame([(1, 1, 0, "| a |")], "doc_id long, page int, table_index int, table_markdown string")
    assert [r.text for r in pdf_blocks.attach_tables(blocks, tables).filter("kind = 'table_row'").collect()] == ["| a |"]
    with pytest.raises(ValueError):
        pdf_blocks.profile("none")
    assert one(spark, pdf_blocks.markdown_table(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))))) == "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_vectors_with_null_and_zero(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    q = rows.filter("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    assert [(r.vec_id, r.similarity) for r in vectors.cosine_top(q, rows, 5).orderBy("rank").collect()] == [(1, 1.0), (4, 0.707107)]
    assert vectors.hash_embedding(spark.createDataFrame([(1, " ")], "i int, t string"), "t").head().embedding is None


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    read = lambda: stream.read_events(spark, f"{tmp_path}/e", events.schema)
    assert drain(spark, stream.tumbling(read()), "t1", "complete").agg(F.sum("n")).head()[0] == events.count()
    assert drain(spark, stream.sliding(read()), "t2", "complete").agg(F.sum("n")).head()[0] == 4 * events.count()
    assert drain(spark, stream.sessions(read()), "t3").agg(F.sum("n")).head()[0] > 0
    assert drain(spark, stream.distinct_events(read()), "t4").count() == events.count()


def test_ingest(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second finds nothing new
        stream.ingest(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == chunking.semantic_chunks(docs).count()


def test_sentence_boundary(spark):
    text = "One two. Three four! Five 3.5 six?"
    assert [one(spark, T.sentence_boundary(F.lit(text), k)) for k in (1, 8, 13, 14, 15, 34)] == [8, 8, 8, 8, 20, 34]
    assert one(spark, T.sentence_boundary(F.lit("no end"), 3)) is None


def test_blank_queries_find_nothing(spark):
    from quarry.operators import keyword

    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " \t"), (2, None), (3, "a")], "query_id int, query string")
    assert {r.query_id for r in keyword.bm25_top(docs, asked, 2).collect()} == {3}


def test_html_that_never_closes():
    """Thousands of open elements, and a main region inside what is dropped elsewhere."""
    root = html.Tree("<li>item " * 3000).root
    html.prune(root)
    assert root.text() == "item " * 3000 and sum(1 for _ in root.walk()) == 3000
    kept = html.sections("http://x/y", "<aside><div role='main'><h1>Kept</h1><p>a paragraph that stays</p></div></aside><footer><p>a paragraph that goes</p></footer>")
    assert [(s["title"], s["content"]) for s in kept] == [("Kept", "a paragraph that stays")]
