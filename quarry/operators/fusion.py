"""Fusing ranked lists, removing repeats, reranking and filtering, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens


def min_max(df: DataFrame, score: str, out: str) -> DataFrame:
    """Scores of each query from 0 to 1; where all are equal, 1 if they are above 0 and else 0."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).when(hi > 0, 1.0).otherwise(0.0))


def weighted(keyword: DataFrame, vector: DataFrame, k: int, keyword_weight: float = 0.3, vector_weight: float = 0.7, normalize_vector: bool = False) -> DataFrame:
    """Weighted fusion of keyword (query_id, doc_id, score) and vector (query_id, doc_id, similarity) lists; a missing side counts 0."""
    total = keyword_weight + vector_weight
    a = min_max(keyword, "score", "b").select("query_id", "doc_id", "b")
    v = min_max(vector, "similarity", "v") if normalize_vector else vector.withColumn("v", F.col("similarity"))
    both = a.join(v.select("query_id", "doc_id", "v"), ["query_id", "doc_id"], "full_outer")
    fused = keyword_weight / total * F.coalesce("b", F.lit(0.0)) + vector_weight / total * F.coalesce("v", F.lit(0.0))
    # rounded by the sum itself, as ties of seven places differ between ways to print it
    return top(both.withColumn("ensemble_score", F.floor(fused * 1_000_000 + 0.5) / 1_000_000), "ensemble_score", k).select("query_id", "doc_id", "ensemble_score", "rank")


def reciprocal(keyword: DataFrame, vector: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists that carry their ranks."""
    both = keyword.select("query_id", "doc_id", "rank").unionByName(vector.select("query_id", "doc_id", "rank"))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("rrf_score"))
    return top(fused, "rrf_score", k)


def top(df: DataFrame, score: str, k: int, item: str = "doc_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), item)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def first_wins(df: DataFrame, item: str = "doc_id") -> DataFrame:
    """Of rows with the same item, the first by query_ord and rank; items that are null or 0 go."""
    order = Window.partitionBy("query_id", item).orderBy("query_ord", "rank")
    kept = df.filter(F.col(item).isNotNull() & (F.col(item) != 0))
    return kept.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def lexical_relevance(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: a stand-in for a cross-encoder."""
    q = F.array_distinct(tokens(query))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best by ``score``, only where a query has more than k candidates; else as they were."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    scored = candidates.withColumn("reranker_score", score).withColumn("many", n > k)
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("many"), -F.col("reranker_score")).otherwise(F.lit(0.0)), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k).drop("many")


def corrective(df: DataFrame, grade: Column, threshold: float = 7.0) -> DataFrame:
    """Rows whose grade (0 to 10) reaches the threshold; a query none of whose rows has a grade keeps all."""
    graded = df.withColumn("relevance_score", grade)
    any_grade = F.count("relevance_score").over(Window.partitionBy("query_id")) > 0
    return graded.withColumn("graded", any_grade).filter(~F.col("graded") | (F.col("relevance_score") >= threshold)).drop("graded")


def with_web(good: DataFrame, web: DataFrame, queries: DataFrame, least: int = 3, score: float = 8.0) -> DataFrame:
    """query_id, item and relevance_score: relevant rows, and found web rows for queries with fewer than ``least`` of them."""
    counts = good.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.select("query_id").distinct().join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < least)
    found = web.join(short.select("query_id"), "query_id", "left_semi").select("query_id", "item", F.lit(score).alias("relevance_score"), F.lit("web").alias("source_type"))
    return good.select("query_id", "item", "relevance_score", F.lit("document").alias("source_type")).unionByName(found)
