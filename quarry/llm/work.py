"""Where operators keep intermediate tables, and how they read ``documents``."""

from __future__ import annotations

import ctypes
import gc
import inspect
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in a local session that names none (as in a test) is a folder made; a
    cluster without the setting is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", there)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(there)
    return there


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage, computed once."""
    return Scratch(df.sparkSession).written(df, name)


class Scratch:
    """Tables that an operator keeps in the shared folder; ``drop`` removes those that nothing needs any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str, str | None]] = []

    def written(self, df: DataFrame, name: str, key: str | None = None) -> DataFrame:
        """The table, written and read back; with ``key`` in buckets by it, so that joins on it move only the other side."""
        path = new_path(self.spark, name)
        # shuffle files are no longer of use once the table stands
        setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(setting, "false")
        self.spark.conf.set(setting, "true")
        try:
            to = df.write.option("compression", "zstd")
            if key:
                table = "quarry_" + uuid.uuid4().hex
                to.bucketBy(parts(self.spark), key).sortBy(key).option("path", path).saveAsTable(table)
            else:
                table = None
                to.parquet(path)
        finally:
            self.spark.conf.set(setting, before)
        out = self.spark.table(table) if table else self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path, table))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove these tables; all of them if none is named."""
        gone = [t for t in self.tables if not tables or any(t[0] is x for x in tables)]
        self.tables = [t for t in self.tables if not any(t[0] is x[0] for x in gone)]
        for _, path, table in gone:
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        if gone := [t[0] for t in self.tables if not any(t[0] is x for x in tables)]:
            self.drop(*gone)


def give_back(cycles: bool = True) -> None:
    """Return memory that a worker no longer uses to the system (where its C library can)."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f):
    """The same function for mapInArrow or applyInArrow; each call gives its memory back, as Spark keeps idle workers."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back(False)

    def one(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back(False)
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        give_back(False)
        return out

    return stream if inspect.isgeneratorfunction(f) else one if f.__code__.co_argcount == 1 else two


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows, so that long texts fit in a Python worker, and Parquet batches of at most 256, so that long rows fit in an executor."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.parquet.columnarReaderBatchSize", 256)):
        if int(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and further columns, under their own names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of input for each bucket: what one group of a bucketed shuffle holds follows from it, not from the corpus.
BUCKET_BYTES = 32 << 20


def buckets(docs: DataFrame, of_bytes: int = BUCKET_BYTES) -> int:
    """Number of buckets for entries of ``docs``: by its bytes, and no fewer than shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # tables that exist in memory only have no size
    return max(parts(docs.sparkSession), -(-size // of_bytes) if size < 1 << 55 else 1)
