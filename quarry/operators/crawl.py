"""Breadth-first search by frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def breadth_first(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """page_id and depth of what seeds reach over edges (a, b) in at most ``depth`` steps.

    ``depth`` joins, whatever the graph; each frontier leaves out what was seen.
    """
    frontier = seeds.select("page_id", F.lit(0).alias("depth")).distinct()
    seen = frontier
    for k in range(1, depth + 1):
        reached = edges.join(frontier.select(F.col("page_id").alias("a")), "a").select(F.col("b").alias("page_id")).distinct()
        frontier = reached.join(seen, "page_id", "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def by_words(seeds: DataFrame, links: DataFrame, pages: DataFrame, depth: int) -> DataFrame:
    """page_id and depth of what seeds reach in at most ``depth`` steps, where a link (a, w) leads to all pages (b, w) of its word.

    A step goes from pages to their words and from each word once to its pages:
    the edges, as many as links of a word times its pages, are never made.
    """
    frontier = seeds.select("page_id", F.lit(0).alias("depth")).distinct()
    seen = frontier
    for k in range(1, depth + 1):
        words = links.join(frontier.select(F.col("page_id").alias("a")), "a", "left_semi").select("w").distinct()
        reached = pages.join(words, "w", "left_semi").select(F.col("b").alias("page_id")).distinct()
        frontier = reached.join(seen, "page_id", "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def crawled(seeds: DataFrame, edges: DataFrame, folder: str, most: int = 1000) -> DataFrame:
    """page_id and depth of all that seeds reach over edges (a, b): work goes on until a step finds nothing new.

    Each step's finds are a folder of their own, so that a step costs its
    frontier, and a run that broke off goes on where it was.
    """
    spark = seeds.sparkSession
    read = lambda: spark.read.schema("page_id long, depth int").parquet(folder)
    seeds.select(F.col("page_id").cast("long").alias("page_id")).distinct().write.mode("overwrite").parquet(f"{folder}/depth=0")
    for k in range(1, most + 1):
        before = read().filter(F.col("depth") < k)
        reached = edges.join(before.filter(F.col("depth") == k - 1).select(F.col("page_id").alias("a")), "a").select(F.col("b").cast("long").alias("page_id")).distinct()
        reached.join(before.select("page_id"), "page_id", "left_anti").write.mode("overwrite").parquet(f"{folder}/depth={k}")
        if read().filter(F.col("depth") == k).isEmpty():
            return read().filter(F.col("depth") < k)
    raise RuntimeError(f"the crawl goes on after {most} steps")
