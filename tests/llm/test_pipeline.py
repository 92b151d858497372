"""The corpus pipeline: each stage's decisions hold, and all rows of the last are whole."""

import collections

import corpus_pipeline
from quarry.llm import mixing, ngram_join, passage_dedup, quality_rules, work


def test_stages(spark, sf):
    docs = work.read_documents(spark, sf)
    columns, counts, was = docs.columns, [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = work.written(stage(spark, was, sf), "stage")
        assert now.columns == columns, name
        ids = collections.Counter(r.doc_id for r in now.select("doc_id").collect())
        if name == "quality rules":
            assert set(ids) == {r.doc_id for r in quality_rules.judge(was).filter("kept").collect()}
        elif name == "n-gram Jaccard join":
            assert set(ids) == {r.component_id for r in ngram_join.ngram_join(was, 5, 80)[0].collect()} and max(ids.values()) == 1
        elif name == "substring dedup":
            want = {r.doc_id: r.text for r in passage_dedup.repeated_passages(was).collect()}
            assert {r.doc_id: r.text for r in now.collect()} == want
            assert now.filter("n_chars <> length(text)").isEmpty()
        else:
            taken = {r.doc_id: r.taken for r in mixing.mix(was).filter("taken > 0").collect()}
            got = collections.Counter()
            for r in now.collect():
                got[r.doc_id] += len(r.text.encode().split())
            assert dict(got) == taken
        was = now
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, was, sf)
    per = last.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toPandas()
    assert set(per["doc_id"]) == {r.doc_id for r in was.select("doc_id").collect()}
    assert last.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()


def test_odd_columns(spark, sf):
    """Columns with blanks, dots, colons and the names that operators use themselves pass through all stages."""
    names = ["a b", "x.y", "p:q", "bucket", "doc_id_", "src", "text_a", "taken"]
    docs = work.read_documents(spark, sf)
    docs = docs.select("*", *[docs["lang"].alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = work.written(stage(spark, docs, sf), "stage")
        assert now.columns == docs.columns and now.count() > 0, name
        assert all(r[n] == r["lang"] for r in now.collect() for n in names), name
        empty = work.written(stage(spark, docs.limit(0), sf), "stage")
        assert empty.columns == docs.columns and empty.count() == 0, name
        docs = now


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_an_encoder_gives_its_words_back():
    """After a task nothing of its words stays in the worker, and the next task gets the same ids."""
    from quarry.llm import tokens

    encoder = tokens.WordEncoder.of(tokens.vocabulary("word_bpe_49k.json"), False)
    texts = [b"Some words, some (other) words", b"caf\xc3\xa9 word"]
    first = encoder.encode(texts, 1)
    assert encoder.known and encoder.parts
    encoder.release()
    assert not (encoder.known or encoder.known.older or encoder.parts or len(encoder.words.name))
    assert encoder.encode(texts, 1) == first
