"""Typed access to the driver tables, and the library view that documents are seen through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a library of files: with file_name, title, status and created_at (minutes from 2024-01-01)."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 10
    status = F.when(n == 0, "pending").when(n == 1, "processing").when(n == 2, "failed").when(n == 3, "deleted").otherwise("completed")
    ext = F.element_at(F.array(*map(F.lit, ("txt", "html", "pdf", "exe"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.concat(F.lit("doc_"), "doc_id", F.lit("."), ext).alias("file_name"),
        F.concat(F.lit("Document "), "doc_id").alias("title"),
        status.alias("status"),
        (F.lit(1704067200) + F.col("doc_id") * 60).alias("created_s"),
    )


#: The same view for DuckDB.
LIBRARY_SQL = """lib AS (SELECT doc_id, text, lang, source,
  'doc_' || doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' ELSE 'exe' END AS file_name,
  'Document ' || doc_id AS title,
  CASE doc_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' WHEN 3 THEN 'deleted' ELSE 'completed' END AS status,
  1704067200 + doc_id * 60 AS created_s FROM documents)"""
