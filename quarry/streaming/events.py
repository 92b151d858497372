"""Streams of events and of documents: windows with watermarks, sessions, ingest; operators with expiring state are in ``stateful``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunking import semantic_chunks


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events as Parquet files arrive; t is their time."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("t", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("t", late).groupBy(F.window("t", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("t", late).groupBy(F.window("t", width, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("t", late).groupBy("user_id", F.session_window("t", gap)).agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is sent within the watermark."""
    return events.withWatermark("t", late).dropDuplicatesWithinWatermark(["event_id"])


def ingest(spark: SparkSession, folder: str, schema, target: str, checkpoint: str):
    """Documents that arrive as Parquet files become chunks; a file is taken up once.  The query, which stops when all is done."""

    def store(batch: DataFrame, epoch: int) -> None:
        semantic_chunks(batch).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    docs = spark.readStream.schema(schema).parquet(folder)
    return docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_index(docs: DataFrame) -> DataFrame:
    """Document frequency of each term over a stream of documents."""
    from quarry.functions.text import tokens

    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
