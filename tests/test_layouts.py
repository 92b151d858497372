"""Prompts, tables in PDF pages, folder ingest, backfill and settings, on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import prompts
from quarry.operators import fusion, pdf_blocks, vectors
from quarry.operators.options import Options
from quarry.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def lines(*x):
    return F.array(*map(F.lit, x))


def test_few_shot_prompt(spark):
    got = one(spark, prompts.prompt("few_shot", F.lit("why {context}?"), F.lit("c"), [("q", "r", "a")]))
    assert got == "Reason as in these examples.\nExample 1\nQuestion: q\nReasoning: r\nAnswer: a\n\nSources:\nc\nQuestion: why {context}?\nReasoning:\n"
    assert one(spark, prompts.prompt("none such", F.lit("q"), F.lit("c"))) == one(spark, prompts.prompt("cot", F.lit("q"), F.lit("c")))


def test_history_alone_and_neither(spark):
    assert one(spark, prompts.with_history(F.lit("h"), F.lit(None))) == "Previous Conversation:\nh"
    assert one(spark, prompts.with_history(F.lit("h"), F.lit("d"))) == "Previous Conversation:\nh\n\n=====\n\nRelevant Documents:\nd"
    assert one(spark, prompts.with_history(F.lit(""), F.lit(None))) is None


def test_shortcut_tables(spark):
    assert one(spark, pdf_blocks.is_shortcut_table(lines("Pan ALT + LEFT", "Zoom ctrl", "words"))) is True
    assert one(spark, pdf_blocks.is_shortcut_table(lines("Pan ALT + LEFT", "Zoom ctrl"))) is False
    assert one(spark, pdf_blocks.is_shortcut_table(lines("Pan ALT", "words", "words", "words"))) is False


def test_tables_by_last_word_or_by_place(spark):
    three = F.array(*map(F.lit, (1.0, 2.0, 3.0)))
    assert one(spark, pdf_blocks.is_table(lines("Copy F5", "Paste +", "Undo it CTRL"), three)) is True
    assert one(spark, pdf_blocks.is_table(lines("Copy it", "Paste it", "Undo CTRL"), three)) is False
    assert one(spark, pdf_blocks.is_table(lines("Copy it", "Paste it", "a longer line with six words"), F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0)))) is True
    assert one(spark, pdf_blocks.is_table(lines("Copy it", "Paste it"), F.array(F.lit(1.0)))) is False


def test_chunk_text(spark):
    b = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in (("heading", "H"), ("paragraph", "p"), ("list_item", "- a"), ("table", "| t |"), ("note", "Note"))])
    assert one(spark, pdf_blocks.chunk_text(b)) == "H\n\np\n- a\n\n| t |\n\nNote"


def test_web_rows_only_where_few(spark):
    good = spark.createDataFrame([(1, "a", 9.0), (1, "b", 8.0), (1, "c", 7.5), (2, "a", 9.0)], "query_id int, item string, relevance_score double")
    web = spark.createDataFrame([(i, f"w{i}") for i in (1, 2, 3, 4)], "query_id int, item string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = fusion.with_web(good, web, asked).filter("source_type = 'web'")
    assert {tuple(r) for r in got.collect()} == {(2, "w2", 8.0, "web"), (3, "w3", 8.0, "web")}


def test_backfill(spark):
    rows = [(1, "a b", [1.0], None), (2, "a b", None, None), (3, "c", [1.0], [5.0]), (4, None, [1.0], None)]
    df = spark.createDataFrame(rows, "id int, text string, embedding array<double>, fresh array<double>")
    got = {r.id: r for r in vectors.backfill(df, "text", "embedding", "fresh").collect()}
    assert len(got[1].fresh) == 64 and got[1].embedding == [1.0]
    assert got[2].fresh is None and got[3].fresh == [5.0] and got[4].fresh is None


def test_folder_and_home(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    page = "<html><body><main><h1>{0}</h1><p>a paragraph of page {0}</p>{1}</main></body></html>"
    (tmp_path / "b.html").write_text(page.format("B", '<a href="sub/a.html#x">a</a><a href="sub/a.html?y=1">a</a><a href="http://x/z.html">z</a><a href="c.pdf">c</a>'))
    (tmp_path / "sub" / "a.html").write_text(page.format("A", ""))
    (tmp_path / "c.txt").write_text("no page")
    assert [r.title for r in readers.ingest_folder(spark, str(tmp_path)).collect()] == ["B", "A"]
    sections, files = readers.ingest_home(spark, str(tmp_path / "b.html"))
    assert [r.title for r in sections.collect()] == ["B"] and [r.file for r in files.collect()] == ["sub/a.html"]


def test_options():
    assert Options().override(k=None, rerank=False) == Options(rerank=False)
    with pytest.raises(TypeError):
        Options().override(none_such=1)


def plain_chunks(blocks, chunk_words, overlap_words, keep_short):
    """Chunks of (kind, text, page) by joining and splitting all that is open at every block."""
    out, buffer, pages, title = [], [], set(), ""
    for kind, text, page in blocks:
        n = len(" ".join(buffer).split())
        if kind == "heading":
            if n > 50 or (keep_short and n):
                out.append((title, "\n".join(buffer), sorted(pages), n))
                buffer, pages = [], set()
            title = text.strip()
            continue
        buffer.append(text.strip())
        pages.add(page)
        words = " ".join(buffer).split()
        if len(words) >= chunk_words:
            out.append((title, "\n".join(buffer), sorted(pages), len(words)))
            buffer = [" ".join(words[-overlap_words:])] if overlap_words else []
    n = len(" ".join(buffer).split())
    if n > 50 or (keep_short and n):
        out.append((title, "\n".join(buffer), sorted(pages), n))
    return out


@pytest.mark.parametrize("name,keep_short", [("default", False), ("presentation", True)])
def test_chunks_in_one_pass(spark, name, keep_short):
    """Each document is a partition of a table function: the chunks of the plain version, in any order of rows."""
    rng, rows, want = random.Random(name), [], {}
    for doc in range(12):
        own = [(rng.choice(["heading"] + ["paragraph"] * 6), " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice((0, 4, 30, 150)))), i // 5) for i in range(60 if doc else 0)]
        rows += [(doc, page, i, text, kind) for i, (kind, text, page) in enumerate(own)]
        p = pdf_blocks.profile(name)
        want |= {(doc, k): c for k, c in enumerate(plain_chunks(own, p["chunk_words"], p["overlap_words"], keep_short))}
    df = spark.createDataFrame(rows, "doc_id long, page int, ordinal int, text string, kind string").repartition(5)
    got = {(r.doc_id, r.chunk_id): (r.title, r.text, list(r.pages), r.words) for r in pdf_blocks.chunks(df, name, keep_short).collect()}
    assert got == want and len(want) > 20


def test_a_long_document_is_chunked_in_one_pass(spark):
    """A hundred thousand blocks without a heading; what is open stays small."""
    n = 100_000
    blocks = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") / 50).cast("int").alias("page"), (F.col("id") % 50).cast("int").alias("ordinal"), F.lit("ten words of text " * 3).alias("text"), F.lit("paragraph").alias("kind"))
    got = pdf_blocks.chunks(blocks).agg(F.count("*").alias("n"), F.max("words").alias("most")).head()
    assert got.most < 520 and abs(got.n - 12 * n / 450) < 200
