"""A library of documents and chunks that changes: logs of changes by epoch, merged when they are read.

Every change is a set of rows in an epoch of its own.  Folders under ``path``:

* ``documents/epoch=`` and ``chunks/epoch=``: rows as they became in an epoch;
  a document's row carries ``op``: ``upsert``, ``soft`` (deleted, but there) or
  ``hard`` (gone, with its chunks);
* ``commits/epoch=``: written last; an epoch without it does not count;
* ``snapshots/epoch=``: the state after an epoch, which replaces all before.

An epoch that is written again starts from the one before and replaces what it
wrote, so a writer that
died, or a stream that sends a batch twice, changes nothing.  A document is its
row of the last epoch; its chunks are those of the last epoch in which it was
upserted or removed for good, so new chunks replace old ones and a removal takes
them along.
Reading costs the snapshot and the changes since; ``compact`` makes a snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunking import semantic_chunks

DOCUMENTS = "doc_id long, title string, status string, text string, op string, at long"
CHUNKS = "doc_id long, chunk_order int, chunk string"
#: A document's status while its chunks are made, and after.
WORKING, DONE = "processing", "completed"


@dataclass(frozen=True)
class Library:
    spark: SparkSession
    path: str

    def _epochs(self, name: str) -> list[int]:
        """Committed epochs, or those of snapshots: one small file each."""
        try:
            return sorted(r["epoch"] for r in self.spark.read.schema("ok boolean, epoch long").parquet(f"{self.path}/{name}").collect())
        except Exception as e:  # nothing there yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def last_epoch(self) -> int:
        return max(self._epochs("commits"), default=-1)

    def _mark(self, name: str, epoch: int) -> None:
        self.spark.createDataFrame([(True,)], "ok boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/epoch={epoch}")

    def _write(self, epoch: int, documents: DataFrame, chunks: DataFrame | None) -> None:
        """An epoch, whole: its rows, then its commit."""
        documents.write.mode("overwrite").parquet(f"{self.path}/documents/epoch={epoch}")
        chunks = self.spark.createDataFrame([], CHUNKS) if chunks is None else chunks
        chunks.write.mode("overwrite").parquet(f"{self.path}/chunks/epoch={epoch}")
        self._mark("commits", epoch)

    # changes

    def upsert(self, epoch: int, docs: DataFrame, at: int = 0, chunked: bool = True) -> None:
        """Documents (doc_id, title, status, text) as they are from now on, with their chunks; of rows with one doc_id the greatest counts.

        Not ``chunked``: they are being worked on, and have no chunks yet.
        """
        row = F.struct("title", "status", "text")
        docs = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(row).alias("row")).select("doc_id", "row.*")
        status = F.col("status") if chunked else F.lit(WORKING)
        rows = docs.select("doc_id", "title", status.alias("status"), "text", F.lit("upsert").alias("op"), F.lit(at).cast("long").alias("at"))
        self._write(epoch, rows, semantic_chunks(docs).select("doc_id", "chunk_order", "chunk") if chunked else None)

    def delete(self, epoch: int, ids: DataFrame, at: int = 0, soft: bool = False) -> None:
        """Documents with these ids: marked as deleted, or gone with their chunks; ids that are not there change nothing."""
        there = self.documents(deleted=True, upto=epoch - 1).join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        gone = there.select("doc_id", "title", "status", "text", F.lit("soft" if soft else "hard").alias("op"), F.lit(at).cast("long").alias("at"))
        self._write(epoch, gone if soft else gone.withColumn("text", F.lit(None).cast("string")), None)

    def apply(self, epoch: int, changes: DataFrame) -> None:
        """A batch of changes (doc_id, title, status, text, op, seq) in one epoch: of each document the last by ``seq`` counts."""
        last = changes.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.struct("seq", "title", "status", "text", "op")).alias("x")).select("doc_id", "x.*")
        # a deletion keeps what the document was
        old = self.documents(deleted=True, upto=epoch - 1).select("doc_id", *[F.col(c).alias(f"old_{c}") for c in ("title", "status", "text")])
        both = last.join(old, "doc_id", "left").filter((F.col("op") == "upsert") | F.col("old_status").isNotNull())
        new = F.col("op") == "upsert"
        rows = both.select("doc_id", *[F.when(new, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("title", "status")], F.when(new, F.col("text")).when(F.col("op") == "soft", F.col("old_text")).alias("text"), "op", F.col("seq").cast("long").alias("at"))
        self._write(epoch, rows, semantic_chunks(last.filter(new)).select("doc_id", "chunk_order", "chunk"))

    def ingest(self, changes: DataFrame, checkpoint: str):
        """Follow a stream of changes, one epoch for each batch; the query, which stops when all is done.

        Epochs follow the last one that was there when the stream first began.
        """
        start = f"{self.path}/streams"
        try:
            first = self.spark.read.parquet(start).filter(F.col("checkpoint") == checkpoint).head()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            first = None
        if first is None:
            first = {"epoch": self.last_epoch() + 1}
            self.spark.createDataFrame([(checkpoint, first["epoch"])], "checkpoint string, epoch long").coalesce(1).write.mode("append").parquet(start)
        base = first["epoch"]

        def store(batch: DataFrame, epoch: int) -> None:
            if base + epoch > self.last_epoch():  # else this batch has been stored before
                self.apply(base + epoch, batch)

        return changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def recover(self, epoch: int, before: int) -> None:
        """Documents that were being worked on at a time before ``before`` are done again from their text; their chunks replace what there was."""
        stuck = self.documents(upto=epoch - 1).filter((F.col("status") == WORKING) & (F.col("at") < before))
        self.upsert(epoch, stuck.select("doc_id", "title", F.lit(DONE).alias("status"), "text"), before)

    # state

    def _since(self, upto: int | None) -> tuple[int | None, list[int]]:
        """The last snapshot and the epochs after it, of those up to ``upto``."""
        some = lambda name: [e for e in self._epochs(name) if upto is None or e <= upto]
        snapshot = max(some("snapshots"), default=None)
        return snapshot, [e for e in some("commits") if snapshot is None or e > snapshot]

    def _rows(self, name: str, schema: str, epochs: list[int]) -> DataFrame:
        if not epochs:
            return self.spark.createDataFrame([], f"{schema}, epoch long")
        return self.spark.read.schema(f"{schema}, epoch long").parquet(f"{self.path}/{name}").filter(F.col("epoch").isin(epochs))

    def _snapshot(self, name: str, schema: str, snapshot: int | None) -> DataFrame:
        if snapshot is None:
            return self.spark.createDataFrame([], f"{schema}, epoch long")
        return self.spark.read.schema(f"{schema}, epoch long").parquet(f"{self.path}/state/{snapshot}/{name}")

    def _documents(self, upto: int | None = None) -> DataFrame:
        """All documents that are there, with their last op and epoch."""
        snapshot, epochs = self._since(upto)
        changes = self._rows("documents", DOCUMENTS, epochs)
        columns = [c for c in changes.columns if c != "doc_id"]
        last = changes.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "epoch").alias("x")).select("doc_id", "x.*")
        # only the changes are merged; what did not change is passed on
        old = self._snapshot("documents", DOCUMENTS, snapshot).join(changes.select("doc_id").distinct(), "doc_id", "left_anti")
        return old.unionByName(last).filter("op <> 'hard'")

    def documents(self, deleted: bool = False, upto: int | None = None) -> DataFrame:
        """doc_id, title, status, text and at of the documents, with ``deleted`` also of those that are marked so; ``upto`` an epoch, as it was then."""
        docs = self._documents(upto)
        return (docs if deleted else docs.filter("op <> 'soft'")).select("doc_id", "title", "status", "text", "at")

    def chunks(self, deleted: bool = False, upto: int | None = None) -> DataFrame:
        """doc_id, chunk_order and chunk of the documents that are there."""
        snapshot, epochs = self._since(upto)
        changes = self._rows("documents", DOCUMENTS, epochs).filter("op <> 'soft'")
        renewed = changes.groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
        fresh = self._rows("chunks", CHUNKS, epochs).join(renewed, ["doc_id", "epoch"], "left_semi")
        kept = self._snapshot("chunks", CHUNKS, snapshot).join(renewed, "doc_id", "left_anti").unionByName(fresh)
        shown = self._documents(upto) if deleted else self._documents(upto).filter("op <> 'soft'")
        return kept.join(shown.select("doc_id"), "doc_id", "left_semi").select("doc_id", "chunk_order", "chunk")

    def compact(self) -> None:
        """A snapshot of the state after the last epoch; what was written before is no longer read."""
        epoch = self.last_epoch()
        docs = self._documents().withColumn("epoch", F.lit(epoch).cast("long"))
        docs.write.mode("overwrite").parquet(f"{self.path}/state/{epoch}/documents")
        self.chunks(deleted=True).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/state/{epoch}/chunks")
        self._mark("snapshots", epoch)
