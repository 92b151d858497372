"""TF-IDF over any corpus (doc_id, text), for many queries at once: a vocabulary of the most frequent n-grams, and cosine scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import frequent
from quarry.operators.keyword import grams

#: Terms of queries that go to all tasks, and sums and products that a task holds at once.
MOST_ASKED, HELD = 1 << 20, 1 << 22


def with_grams(df: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """key and g: all n-grams of the text, built within its array of words."""
    df = df.select(key, grams(F.col(text)).alias("w"))
    runs = [F.col("w")]
    for k in range(2, most + 1):  # a run of k words is one of k - 1 and the word after it
        runs.append(F.zip_with(runs[-1], F.slice("w", F.lit(k), F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)))
    return df.select(key, F.array_compact(F.concat(*runs)).alias("g"))


def gram_rows(df: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """key, term and n of each n-gram (with_grams) that the vocabulary has."""
    each = df.select(key, F.explode("g").alias("term")).join(vocab.select("term"), "term", "left_semi")
    return each.groupBy(key, "term").agg(F.count("*").alias("n"))


def counted_vocabulary(df: DataFrame, most: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """The most frequent n-grams (with_grams; ties by term) within the bounds of document frequency, with smoothed idf.

    All n-grams are counted, occurrences and documents in one shuffle of partial sums.
    """
    n_docs = df.agg(F.count("*").alias("n_docs"))
    one = lambda terms, total, docs: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(total).alias("total"), F.lit(docs).alias("df")))
    each = df.select(F.explode(F.concat(one(F.col("g"), 1, 0), one(F.array_distinct("g"), 0, 1))).alias("x")).select("x.*")
    counts = each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    counts = counts.join(F.broadcast(n_docs)).filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
    return counts.orderBy(F.desc("total"), "term").limit(most).select("term", "df", "total", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def vocabulary(corpus: DataFrame, most: int, n: int = 3, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """term, h, df, total and smoothed idf of the ``most`` most frequent n-grams: by candidates and counts of these, or, where that cannot tell, by counting all (h is null then)."""
    found = frequent.most_frequent(corpus, "doc_id", "text", most, n, min_df, max_df)
    if found is None:
        return counted_vocabulary(with_grams(corpus, "doc_id", "text", n), most, min_df, max_df).withColumn("h", F.lit(None).cast("long"))
    return found.select("term", "df", "total", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"), "h")


def weights(rows: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """L2-normed tf-idf weights with 1 + ln(tf)."""
    w = rows.join(vocab.select("term", "idf"), "term").withColumn("w", (1 + F.log("n")) * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def document_weights(corpus: DataFrame, terms: list[tuple[int, float]], n: int, then=None, schema: str = "doc_id long, h long, w double", carry: str | None = None) -> DataFrame:
    """doc_id, h and w (and ``carry``), the L2-normed weights of the n-grams (hash and idf) that each document has; a document is done within its task, and ``then`` makes of these batches, each of whole documents, those of ``schema``."""
    order = np.argsort(np.array([h for h, _ in terms], np.int64).view(np.uint64))
    hashes, idf = (np.array([t[k] for t in terms], kind)[order] for k, kind in ((0, np.int64), (1, np.float64)))
    words = frequent.hashed_words(corpus, "doc_id", "text", *[carry] * bool(carry))

    def weigh(batches):
        for b in batches:
            key, h, tf = (b.column(c).to_numpy() for c in ("key", "h", "n"))
            w = (1 + np.log(tf)) * idf[np.searchsorted(hashes.view(np.uint64), h.view(np.uint64))]
            # a document's rows stand together in the batch that was made for it
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            norm = np.sqrt(np.add.reduceat(w * w, first)) if len(first) else w
            w = w / np.repeat(norm, np.diff(np.r_[first, len(key)]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h), pa.array(w), *b.columns[3:]], names=["doc_id", "h", "w", *b.schema.names[3:]])

    return frequent.term_rows(words, hashes.view(np.uint64), n, (lambda batches: then(weigh(batches))) if then else weigh, schema, carry)


def _sums(asked: list[tuple[int, int, float]]):
    """What makes query_id, doc_id, score and all further columns of batches of whole documents' weights: a document's products with the queries (query_id, h, weight) add up in its task."""
    ids, of = np.unique(np.array([a for a, _, _ in asked], np.int64), return_inverse=True)
    h, qw = np.array([a for _, a, _ in asked], np.int64), np.array([a for _, _, a in asked], np.float64)
    order = np.argsort(h, kind="stable")
    of, h, qw = of[order], h[order], qw[order]

    def run(batches):
        for b in batches:
            doc, term, w = (b.column(c).to_numpy() for c in ("doc_id", "h", "w"))
            lo = np.searchsorted(h, term)
            hits = np.searchsorted(h, term, "right") - lo
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc)]))
            # documents whose products and sums are held at once
            held = np.cumsum(np.add.reduceat(hits, first) + len(ids)) // HELD if len(first) else first
            for part in np.unique(held):
                x, y = np.searchsorted(held, part), np.searchsorted(held, part, "right")
                i = np.arange(first[x], first[y] if y < len(first) else len(doc))
                n = hits[i]
                at = np.repeat(lo[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pair = np.repeat(row[i] - x, n) * len(ids) + of[at]
                there = np.flatnonzero(np.bincount(pair, minlength=(y - x) * len(ids)))
                score = np.bincount(pair, np.repeat(w[i], n) * qw[at], (y - x) * len(ids))[there]
                where = pa.array(first[x + there // len(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[there % len(ids)]), b.column("doc_id").take(where), pa.array(score), *[c.take(where) for c in b.columns[3:]]], names=["query_id", "doc_id", "score", *b.schema.names[3:]])

    return run


def tfidf_scores(corpus: DataFrame, queries: DataFrame, most: int = 5000, n: int = 3, min_df: int = 1, max_df: float = 1.0, carry: str | None = None) -> DataFrame:
    """query_id, doc_id and cosine similarity (six places) of pairs that share a term of the vocabulary, with ``carry``, a whole number that ``corpus`` has for each document.

    Tasks score their own documents with all queries, so no pair is shuffled;
    only of very many queries the terms are joined.
    """
    vocab = vocabulary(corpus, most, n, min_df, max_df)
    q = weights(gram_rows(with_grams(queries, "query_id", "query", n), "query_id", vocab), vocab, "query_id").withColumnRenamed("w", "qw")
    terms = vocab.select("h", "idf").filter("h is not null").collect()  # ``most`` rows
    if terms:
        q = q.join(F.broadcast(vocab.select("term", "h")), "term").select("query_id", "h", "qw").persist()
        if q.count() <= MOST_ASKED:
            asked = [(r["query_id"], r["h"], r["qw"]) for r in q.collect()]
            of = queries.schema["query_id"].dataType
            more = [carry] * bool(carry)
            schema = ", ".join(["query_id long", "doc_id long", "score double", *[f"{c} long" for c in more]])
            kept = corpus.select("doc_id", "text", *[F.col(c).cast("long").alias(c) for c in more])
            scored = document_weights(kept, [tuple(t) for t in terms], n, _sums(asked), schema, carry)
            return scored.select(F.col("query_id").cast(of).alias("query_id"), "doc_id", F.round("score", 6).alias("score"), *more)
        joined = q.join(document_weights(corpus, [tuple(t) for t in terms], n), "h")
    else:
        joined = q.join(weights(gram_rows(with_grams(corpus, "doc_id", "text", n), "doc_id", vocab), vocab, "doc_id"), "term")
    found = joined.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))
    return found.join(corpus.select("doc_id", F.col(carry).cast("long").alias(carry)), "doc_id").select("query_id", "doc_id", "score", carry) if carry else found
