"""Sinks: chunk tables, indexes, logs, exports, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.keyword_index import KeywordIndex


def write_results(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON, and as text files with a rule between chunks."""
    chunks.write.mode("overwrite").json(f"{path}/json")
    chunks.select(F.concat("chunk", F.lit("\n" + "=" * 80)).alias("value")).write.mode("overwrite").text(f"{path}/txt")


def save_index(corpus: DataFrame, path: str) -> KeywordIndex:
    """A stored BM25 index of the corpus, ready to be searched."""
    return KeywordIndex.build(corpus, path)


def extend_index(corpus: DataFrame, path: str) -> KeywordIndex:
    """The stored index with new documents; those that it has already are replaced, not added twice."""
    index = KeywordIndex(corpus.sparkSession, path)
    index.update(corpus)
    return index


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``base`` with the same key."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def insert_missing(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``base`` lacks are added."""
    return base.unionByName(new.join(base.select(key), key, "left_anti"))


def log_row(stats: DataFrame, operation: str) -> DataFrame:
    """A row of the processing log from started_us, finished_us, chunks, tokens and error."""
    ok = F.col("error").isNull()
    return stats.select(F.lit(operation).alias("operation"), F.when(ok, "completed").otherwise("failed").alias("status"), ((F.col("finished_us") - F.col("started_us")) / 1e6).alias("seconds"), "chunks", "tokens", F.substring("error", 1, 1000).alias("error"))


def add_column(df: DataFrame, name: str, kind: str, default) -> DataFrame:
    """The column with a default where it is absent."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))
