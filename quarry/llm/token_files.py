"""Token ids as files of Simple-8b words.

A 64-bit word holds a selector in its top four bits and, in the other sixty,
as many ids of equal width as the selector says.  Selector 15 is the escape:
one id of up to sixty bits stands alone.  Ids come in blocks of ``BLOCK``; each
block starts at a word of its own, whose index is kept, so all blocks of a file
row are decoded side by side.

The files are Parquet rows written by Spark's committer, which survives lost
executors and reaches any store: one row holds a run of documents in ascending
doc_id order (their ids, their token counts, the block offsets and the words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks, tokens, work

BLOCK = 512
#: Ids that a reader decodes at a time: whole blocks.
DECODED = 256 * BLOCK
ESCAPE = 15
#: Ids in a word and bits of each, by selector.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30)}

FILE_SCHEMA = "shard int, chunk int, first_doc long, n_ids long, doc_ids binary, doc_tokens binary, block_words binary, words binary"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and the number of words of each block of ``BLOCK`` ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    lanes = -(-n // BLOCK)
    ids = ids.astype(np.uint64)
    length = np.full(lanes, BLOCK)
    length[-1] = n - (lanes - 1) * BLOCK
    width = bit_widths(ids)
    left = (length[:, None] - np.arange(BLOCK)[None, :]).reshape(-1)[:n]
    # the selector of a word that would start at each id: the one that holds most
    best = np.full(n, ESCAPE, np.uint8)
    for s in sorted(SELECTORS, reverse=True):
        count, bits = SELECTORS[s]
        fits = blocks.window_min(width, count, np.maximum) <= bits
        fits &= left[: len(fits)] >= count
        best[: len(fits)][fits] = s
    counts = np.ones(16, np.int64)
    for s, (count, _) in SELECTORS.items():
        counts[s] = count
    # all blocks step from word to word side by side
    at, end = np.arange(lanes) * BLOCK, np.arange(lanes) * BLOCK + length
    steps = []
    while len(at):
        steps.append(at)
        at = at + counts[best[at]]
        going = at < end
        at, end = at[going], end[going]
    start = np.sort(np.concatenate(steps))
    selector = best[start].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        m = np.flatnonzero(selector == s)
        count, bits = SELECTORS.get(int(s), (1, 60))
        body = words[m]
        for j in range(count):
            body |= ids[start[m] + j] << np.uint64(j * bits)
        words[m] = body
    return words, np.bincount(start // BLOCK, minlength=lanes).astype(np.uint32)


def bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, at most 60."""
    out = np.zeros(len(ids), np.uint8)
    small = ids < len(_WIDTHS)
    out[small] = _WIDTHS[ids[small].astype(np.int64)]
    if not small.all():
        out[~small] = np.array([int(x).bit_length() for x in ids[~small].tolist()], np.uint8)
    return out


_WIDTHS = np.ceil(np.log2(np.arange(1 << 17) + 1)).astype(np.uint8)


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ids, all words at once: a word's place follows from the counts before it."""
    if not n:
        return np.zeros(0, np.uint64)
    s = (words >> np.uint64(60)).astype(np.int64)
    counts = np.ones(16, np.int64)
    for k, (count, _) in SELECTORS.items():
        counts[k] = count
    held = counts[s]
    at = np.cumsum(held) - held
    out = np.zeros(n, np.uint64)
    low = np.uint64((1 << 60) - 1)
    for k in np.unique(s):
        m = s == k
        count, bits = SELECTORS.get(int(k), (1, 60))
        mask = np.uint64((1 << bits) - 1)
        body, place = words[m] & low, at[m]
        for j in range(count):
            out[place + j] = (body >> np.uint64(j * bits)) & mask
    return out


def decode_range(words: np.ndarray, per_block: np.ndarray, n: int, begin: int, end: int) -> np.ndarray:
    """The ids from ``begin`` to ``end`` of ``n``: only the blocks that hold them are decoded, found by their offsets."""
    begin, end = max(begin, 0), min(end, n)
    if begin >= end:
        return np.zeros(0, np.uint64)
    offset = np.r_[0, np.cumsum(per_block.astype(np.int64))]
    a, b = begin // BLOCK, -(-end // BLOCK)
    ids = decode(words[offset[a] : offset[b]], min(n, b * BLOCK) - a * BLOCK)
    return ids[begin - a * BLOCK : end - a * BLOCK]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, spaced: bool, chunk_ids: int = 1 << 20) -> None:
    """Encode every text (null: empty) and write its ids, ``end_id`` appended, in ascending doc_id order.

    Shards are ranges of doc_id, so no task holds more than its range; within a
    shard, rows (chunks) of about ``chunk_ids`` ids follow each other.  Repeated
    doc_ids stay side by side.  An empty table gives an empty file set.
    """

    def run(batches):
        shard, k = TaskContext.get().partitionId(), 0
        encoder = tokens.WordEncoder.of(vocabulary, spaced)
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        doc_ids: list[np.ndarray] = []
        held = 0

        def chunk():
            flat = np.concatenate(ids)
            words, per_block = encode(flat)
            own = np.concatenate(doc_ids)
            n = np.concatenate(counts).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([int(own[0])]), pa.array([len(flat)], pa.int64())]
                + [blocks.binary_column([x.tobytes()]) for x in (own.astype("<i8"), n, per_block.astype("<u4"), words.astype("<u8"))],
                names=["shard", "chunk", "first_doc", "n_ids", "doc_ids", "doc_tokens", "block_words", "words"],
            )

        for s in blocks.slices(batches):
            got, n = encoder.encode_rows(s.buf, s.off, end_id)
            ids.append(got)
            counts.append(n)
            doc_ids.append(s.column("doc_id").astype(np.int64))
            held += len(got)
            if held >= chunk_ids:
                yield chunk()
                ids, counts, doc_ids, held, k = [], [], [], 0, k + 1
        if ids:
            yield chunk()

    spark = docs.sparkSession
    ranged = work.texts(docs).repartitionByRange(work.parts(spark), "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document; with_ids: its ids as well.

    Files are decoded where they are read; only one small row a document meets
    the offsets of shards and chunks.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    within = Window.partitionBy("shard").orderBy("chunk")
    chunks = files.select("shard", "chunk", "n_ids").withColumn("before_chunk", F.sum("n_ids").over(within) - F.col("n_ids"))
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a shard: this window is as long as the list of tasks that wrote
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before_shard"))
    starts = chunks.join(shards, "shard").select("shard", "chunk", (F.col("before_shard") + F.col("before_chunk")).alias("before"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                words, per_block = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["block_words"], "<u4")
                n = np.frombuffer(r["doc_tokens"], "<u4").astype(np.int64)
                end = np.cumsum(n)
                raw = b"".join(decode_range(words, per_block, r["n_ids"], x, x + DECODED).astype("<u4").tobytes() for x in range(0, r["n_ids"], DECODED))
                parts = [raw[4 * a : 4 * e] for a, e in zip(end - n, end, strict=True)]
                columns = [pa.array([r[k]] * len(n), pa.int32()) for k in ("shard", "chunk")]
                columns += [pa.array(np.frombuffer(r["doc_ids"], "<i8")), pa.array(end - n), pa.array(n), pa.array([tokens.crc(p) for p in parts], pa.int64())]
                names = ["shard", "chunk", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(blocks.binary_column(parts))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "shard int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    read = files.select("shard", "chunk", "n_ids", "doc_ids", "doc_tokens", "block_words", "words").mapInArrow(run, schema)
    return read.join(starts, ["shard", "chunk"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``documents`` as token files (byte-level vocabulary, end id 0) and reads them back."""
    path = work.new_path(spark, "token-files")
    docs = work.read_documents(spark, sf_dir)
    write_token_files(docs, path, tokens.vocabulary("byte_bpe_50k.json"), 0, spaced=True)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
