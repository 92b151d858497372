"""BM25 over any corpus (doc_id, text), for many queries at once, and the words that keyword searches share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Scores add up in whole units of this part.
SCALE = 1_000_000_000

#: English words that carry no topic; the list is ours.
STOP_WORDS = """a about above after again against all am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its
itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such
than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which
while who whom why will with would you your yours yourself yourselves""".split()


def postings(corpus: DataFrame) -> DataFrame:
    """term, doc_id, tf."""
    words = corpus.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def document_lengths(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("dl"))


def term_stats(posted: DataFrame, n_docs: Column | int) -> DataFrame:
    """term, df and idf; a negative idf gives way to a share of the mean.

    The mean is over all terms: one row, which joins as a scalar.
    """
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    raw = posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf0", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf0").alias("mean_idf"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("idf0") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf0")).alias("idf"), "mean_idf")


def bm25_parts(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id and part: what each term of a query (query_id, query) that a document has adds to its score, in units of ``1 / SCALE``.

    Whole numbers add up alike in any order, so sums are the same in every run.
    A query's repeated words count as often as they occur: they become a
    weight, so a term meets its postings once.  Only terms of queries become
    postings, with the length of their document; all others count in the mean.
    """
    words = corpus.select("doc_id", tokens(F.col("text")).alias("w"))
    # one row: number of documents and their mean length
    shape = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    terms = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = terms.select("term").distinct()
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(shape.select("n"))).withColumn("idf0", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf0").alias("m"))
    stats = raw.join(asked, "term", "left_semi").join(F.broadcast(mean)).select("term", F.when(F.col("idf0") < 0, EPSILON * F.col("m")).otherwise(F.col("idf0")).alias("idf"))
    posted = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(asked, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    hits = posted.join(terms.join(stats, "term"), "term").join(F.broadcast(shape.select("avgdl")))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.select("query_id", "doc_id", F.floor(part * SCALE + 0.5).alias("part"))


def summed(parts: DataFrame) -> DataFrame:
    """The sums, rounded to six places while they are whole."""
    six = SCALE // 1_000_000
    total = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))
    return total.select("query_id", "doc_id", (F.floor((F.col("part") + six // 2) / six) / 1_000_000).alias("score"))


def bm25_scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score (six places) for every document that shares a term with a query (query_id, query)."""
    return summed(bm25_parts(corpus, queries))


def not_blank(queries: DataFrame, text: str = "query") -> DataFrame:
    """Queries of white space alone, or none, have no results."""
    return queries.filter(F.size(tokens(F.col(text))) > 0)


def ranked(scored: DataFrame, k: int, score: str = "score", item: str = "doc_id") -> DataFrame:
    """The k best rows of each query, ties by item, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_top(corpus: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """The k best documents of each query with a score of ``min_score`` or more.

    Documents without a common word score zero, so with ``min_score`` 0 they
    fill up short lists; among the 2k least doc_ids there are always enough.
    """
    queries = not_blank(queries)
    parts = bm25_parts(corpus, queries)
    if min_score <= 0:
        least = corpus.select("doc_id").orderBy("doc_id").limit(2 * k)
        parts = parts.unionByName(queries.select("query_id").distinct().join(F.broadcast(least)).withColumn("part", F.lit(0).cast("long")))
    return ranked(summed(parts).filter(F.col("score") >= min_score), k)


def grams(c: Column) -> Column:
    """The words that n-grams are made of: two or more letters, digits or underscores, and no stop word."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))
