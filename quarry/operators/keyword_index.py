"""A stored BM25 index: postings in buckets of terms and ranges of documents, searched without reading a document.

Folders under ``path``; each update is a segment of its own:

* ``docs/seg=``: doc_id, dl (words), range, and the document's distinct terms
  with how often it has each;
* ``postings/seg=/bucket=``: blocks for each term and range of ``RANGE``
  documents, with the block's largest tf and least dl beside the doc_ids, tfs and dls of its entries;
* ``terms/seg=/bucket=``: term and what the segment adds to its df;
* ``frequencies/seg=``: how many terms have which df, as changes; the mean idf
  over all terms follows from it;
* ``dead/seg=``: doc_id and the segment in which it no longer counts;
* ``manifest/version=``: the segments that count, with their documents and
  words.  A version is written last, so a writer that dies leaves no trace and
  its segment number is used again.

Documents and postings are made where their texts are read: a task turns its own
documents into blocks, and only document frequencies are shuffled.

A search brings the blocks of its terms together by groups of ``GROUP`` ranges.
Blocks of queries meet each group in one task, which keeps every query's k best
of all groups that it meets; so what is shuffled grows with the postings, and
with queries times partitions, never with queries times documents or groups.
Only time is that of queries times documents.  Many queries ask for most terms,
so their groups are made of the stored documents where these are read, and no
postings are shuffled.

Documents lie in ranges by length, so that a block's bound (its largest tf and
least dl under the query's weights) is near what its documents reach.  A search
that prunes adds up the most that a short query's terms reach in a group and
passes over those that cannot reach the k-th score which its task has found;
``pruned`` does so by ranges and stored bounds.  The rows are those of scoring
everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators import keyword
from quarry.operators.keyword import EPSILON, K1, SCALE, B

#: Documents of a range.
RANGE = 2048
#: Ranges whose documents are scored together, and queries (by hash, so about that many) that meet them at once.
GROUP, QUERY_BLOCK = 2, 8192
#: Found rows that a task holds until it puts the best of them together.
HELD = 1 << 21
SIX = SCALE // 1_000_000
#: Ranges of a query that are scored before any is passed over.
FIRST = 4
#: Most distinct words of a query whose ranges are passed over by bounds (where that is asked for): those of long queries add up to what no document reaches.
SHORT = 8
#: Most characters of queries whose blocks are broadcast, and of those that read the blocks of their own terms only.
BROADCAST_CHARS, FEW_CHARS = 8 << 20, 1 << 16
#: Fixed schemas of the stored tables, with their partitions.
SCHEMAS = {
    "docs": "doc_id long, dl long, terms array<string>, tfs array<int>, range long, seg int",
    "postings": "term string, range long, n int, max_tf long, min_dl long, doc_ids array<long>, tfs array<int>, dls array<int>, seg int, bucket int",
    "terms": "term string, df long, seg int, bucket int",
    "frequencies": "df long, n long, seg int",
    "dead": "doc_id long, dead_seg int, dl long, terms array<string>, seg int",
}
#: Columns of a block that hold its entries.
ENTRIES = ("doc_ids", "tfs", "dls")
#: Bytes of text whose words are counted at once.
SLICE_BYTES = 16 << 20
#: Buckets of terms: folders that a search reads only where its terms are.
BUCKETS = 16


def _part(weight: Column, tf: Column, dl: Column, avgdl: float) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _idf(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _lists(values: pa.Array, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), values)


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, dl, terms and tfs of batches of doc_id and lower-case text (none is null), cut into slices of about ``SLICE_BYTES``."""
    for b in batches:
        end = np.cumsum(pc.binary_length(b.column(1)).to_numpy().astype(np.int64))
        first = np.flatnonzero(np.diff(end // SLICE_BYTES, prepend=-1))
        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(end)], strict=True):
            yield _counted(b.column(0).slice(x, y - x), b.column(1).slice(x, y - x))


def _counted(ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
    w = pc.ascii_split_whitespace(text)  # the white space of Java's \s
    words = w.flatten()
    row = np.repeat(np.arange(len(ids)), np.diff(w.offsets.to_numpy()))
    there = pc.greater(pc.binary_length(words), 0)  # what stands before the first white space or after the last may be nothing
    words, row = words.filter(there).dictionary_encode(), row[there.to_numpy(zero_copy_only=False)]
    most, dl = max(len(words.dictionary), 1), np.bincount(row, minlength=len(ids))
    pair, tf = np.unique(row * most + words.indices.to_numpy(), return_counts=True)
    each = np.bincount(pair // most, minlength=len(ids))
    terms, tfs = _lists(words.dictionary.take(pa.array(pair % most)), each), _lists(pa.array(tf.astype(np.int32)), each)
    return pa.RecordBatch.from_arrays([ids, pa.array(dl.astype(np.int64)), terms, tfs], names=["doc_id", "dl", "terms", "tfs"])


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (term, range, n, max_tf, min_dl, doc_ids, tfs, dls) of batches of doc_id, dl, range, terms and tfs; a range that lies in two batches has blocks of both."""
    for b in batches:
        doc, dl, rng = (b.column(c).to_numpy() for c in ("doc_id", "dl", "range"))
        size = np.diff(b.column("terms").offsets.to_numpy())
        words, tf = b.column("terms").flatten().dictionary_encode(), b.column("tfs").flatten().to_numpy()
        if not len(words):
            continue
        row, code = np.repeat(np.arange(len(size)), size), words.indices.to_numpy()
        order = np.lexsort((doc[row], code, rng[row]))
        row, code, tf = row[order], code[order], tf[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (rng[row][1:] != rng[row][:-1])])
        n = np.diff(np.r_[first, len(code)])
        entries = [_lists(pa.array(x), n) for x in (doc[row], tf, dl[row].astype(np.int32))]
        most, least = np.maximum.reduceat(tf, first).astype(np.int64), np.minimum.reduceat(dl[row], first)
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), pa.array(rng[row[first]]), pa.array(n.astype(np.int32)), pa.array(most), pa.array(least), *entries], names=["term", "range", "n", "max_tf", "min_dl", "doc_ids", "tfs", "dls"])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seg, group, blocks) of batches of doc_id, dl, range, terms and tfs: the postings of groups of documents that stand together; their names hold within a task."""
    names, held, n, group = ["seg", "group", "blocks"], [], 0, 0

    def row() -> pa.RecordBatch:
        docs = pa.Table.from_batches(held).set_column(2, "range", pa.array(np.zeros(n, np.int64))).combine_chunks()
        blocks = [pa.StructArray.from_arrays([b.column(c) for c in ("term", *ENTRIES)], ["term", *ENTRIES]) for b in inverted(docs.to_batches())]
        blocks = pa.concat_arrays(blocks) if blocks else pa.array([], blocks_type)
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([group], pa.int64()), _lists(blocks, np.array([len(blocks)]))], names=names)

    blocks_type = pa.struct([("term", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32()))])
    for b in batches:
        for a in range(0, b.num_rows, GROUP * RANGE):
            held.append(b.slice(a, GROUP * RANGE))
            n += held[-1].num_rows
            if n >= GROUP * RANGE:
                yield row()
                held, n, group = [], 0, group + 1
    if n:
        yield row()


class Group:
    """The postings of a group of documents, ready to be added up."""

    def __init__(self, blocks: pa.StructArray, avgdl: float):
        size = np.diff(blocks.field("doc_ids").offsets.to_numpy())
        doc, self.tf, self.dl = (blocks.field(c).flatten().to_numpy() for c in ("doc_ids", "tfs", "dls"))
        self.docs, self.at = np.unique(doc, return_inverse=True)
        words = blocks.field("term").dictionary_encode()
        code = np.repeat(words.indices.to_numpy(), size)
        order = np.argsort(code, kind="stable")
        self.at, self.tf, self.dl = self.at[order], self.tf[order], self.dl[order]
        self.begin = np.searchsorted(code[order], np.arange(len(words.dictionary) + 1))
        self.terms, self.avgdl, self.made, self.most = words.dictionary, avgdl, {}, {}

    def part(self, code: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents that have a term, and what it adds to their scores: whole numbers, as ``_part`` gives them."""
        if (code, weight) not in self.made:
            a, b = self.begin[code], self.begin[code + 1]
            tf, dl = self.tf[a:b], self.dl[a:b]
            at, part = self.at[a:b], np.floor(weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl)) * SCALE + 0.5)
            if 4 * (b - a) > len(self.docs):  # many have the term: what it adds to all of them is added faster
                every = np.zeros(len(self.docs))
                every[at] = part
                at, part = slice(None), every
            self.made[code, weight] = at, part
        return self.made[code, weight]

    def bound(self, code: int, weight: float) -> float:
        """The most that a term adds to a score here."""
        if (code, weight) not in self.most:
            self.most[code, weight] = max(self.part(code, weight)[1].max(), 0.0)
        return self.most[code, weight]

    def best(self, ids: np.ndarray, begin: np.ndarray, terms: pa.Array, weight: np.ndarray, k: int, always: int, tops: np.ndarray, prune: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query_id, doc_ids, parts) of the k best documents of each query, ties by doc_id, as far as they reach the k-th best so far; where that is not above 0, also of those up to ``always`` that share a term with it.

        tops: the k best scores of each query so far, ascending; those found here
        are put among them. prune: a short query is passed over where its k-th
        best cannot be reached.
        """
        code = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy()
        total = np.zeros(len(self.docs))  # whole numbers far below 2 ** 53
        for n, (q, a, b) in enumerate(zip(ids.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            kth = tops[n, 0]
            own = [(c, w) for c, w in zip(code[a:b].tolist(), weight[a:b].tolist(), strict=True) if c >= 0]
            if prune and b - a <= SHORT and np.floor((sum(self.bound(c, w) for c, w in own) + SIX // 2) / SIX) < max(kth, 0):
                continue
            total.fill(0)
            for c, w in own:
                at, part = self.part(c, w)
                total[at] += part
            if kth > 0:  # k documents are above 0, so neither what is below them nor what fills short lists is among the best
                hit = np.flatnonzero(total >= kth * SIX - SIX // 2)
            else:
                there = np.zeros(len(self.docs), bool)
                for c, _ in own:
                    there[self.at[self.begin[c] : self.begin[c + 1]]] = True
                hit = np.flatnonzero(there)
            if not len(hit):
                continue
            six = np.floor((total[hit] + SIX // 2) / SIX)
            i = np.argsort(-six, kind="stable")[:k]
            tops[n] = np.sort(np.r_[tops[n], six[i]])[-k:]
            if kth <= 0:
                i = np.union1d(i, np.flatnonzero(self.docs[hit] <= always))
            yield q, self.docs[hit[i]], total[hit[i]].astype(np.int64)


class Held:
    """Found rows (query_id, doc_id, part) of a task: the k best of each query, ties by doc_id, and those of documents up to ``always``; about ``HELD`` at most, beyond that they are given on."""

    def __init__(self, k: int, always: int):
        self.k, self.always, self.rows, self.number = k, always, [], 0

    def add(self, *row: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.number += len(row[0])
        if self.number > HELD:
            best = self.best()
            if len(best[0]) > HELD // 2:
                yield from self.given(best)
            else:
                self.rows, self.number = [best], len(best[0])

    def best(self) -> tuple[np.ndarray, ...]:
        query, doc, part = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((doc, -((part + SIX // 2) // SIX), query))
        first = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        order = order[(nth < self.k) | (doc[order] <= self.always)]
        return query[order], doc[order], part[order]

    def given(self, best: tuple[np.ndarray, ...] | None = None) -> Iterator[pa.RecordBatch]:
        if self.number:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best or self.best()], names=["query_id", "doc_id", "part"])
        self.rows, self.number = [], 0


def _values(column: pa.ListArray, i: int) -> pa.StructArray:
    """What row i of a list column holds."""
    a, b = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    return column.values.slice(a, b - a)


@dataclass(frozen=True)
class KeywordIndex:
    spark: SparkSession
    path: str

    # what is stored

    def manifest(self) -> list:
        """The segments of the last version, one row each: seg, docs, words, buckets."""
        every = self.spark.read.parquet(f"{self.path}/manifest")
        last = every.agg(F.max("version")).head()[0]
        return every.filter(F.col("version") == last).collect()

    def _read(self, name: str, segs: list[int]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}").filter(F.col("seg").isin(segs))

    def _live(self, segs: list[int]) -> DataFrame:
        """Rows of ``docs`` that count."""
        docs = self._read("docs", segs)
        if len(segs) == 1:
            return docs
        return docs.join(self._read("dead", segs).select("doc_id", F.col("dead_seg").alias("seg")), ["doc_id", "seg"], "left_anti")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")

    # writing

    def _commit(self, kept: list, seg: int, docs: int, words: int, buckets: int, version: int) -> None:
        rows = [(r["seg"], r["docs"], r["words"], r["buckets"]) for r in kept] + [(seg, docs, words, buckets)]
        self.spark.createDataFrame(rows, "seg int, docs long, words long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _segment(self, seg: int, docs: DataFrame, gone: DataFrame, old: list, buckets: int, keep: bool) -> None:
        """Write a segment of docs (doc_id, dl, terms, tfs; in the order of lengths within partitions), in which ``gone`` (doc_id, dead_seg, dl, terms) no longer count."""
        spark, at = self.spark, lambda name: f"{self.path}/{name}/seg={seg}"
        ranged = docs.withColumn("range", F.floor(F.monotonically_increasing_id() / RANGE))
        ranged.write.mode("overwrite").parquet(at("docs"))
        gone.write.mode("overwrite").parquet(at("dead"))
        # the stored rows, so that a document's range is the same wherever it is read
        placed = spark.read.parquet(at("docs")).select("doc_id", "dl", "range", "terms", "tfs")
        blocks = placed.mapInArrow(inverted, "term string, range long, n int, max_tf long, min_dl long, doc_ids array<long>, tfs array<int>, dls array<int>")
        blocks.withColumn("bucket", self._bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        # a block has a term's documents, so terms are counted by blocks
        more = spark.read.schema("term string, n int, bucket int").parquet(at("postings")).select("bucket", "term", F.col("n").alias("df"))
        fewer = spark.read.parquet(at("dead")).select(F.explode("terms").alias("term"), F.lit(-1).alias("df")).withColumn("bucket", self._bucket(buckets))
        change = more.unionByName(fewer).groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
        change.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at("terms"))
        changed = spark.read.schema("term string, df long, bucket int").parquet(at("terms"))
        if old and keep:
            known = self._read("terms", [r["seg"] for r in old]).join(changed.select("term", "bucket"), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("was"))
            both = changed.join(known, ["bucket", "term"], "left").select(F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.col("df")).alias("df"))
            moves = both.select(F.explode(F.array(F.struct(F.col("was").alias("df"), F.lit(-1).alias("n")), F.struct("df", F.lit(1).alias("n")))).alias("x")).select("x.*")
        else:
            moves = changed.select("df", F.lit(1).alias("n"))
        moves.filter("df > 0").groupBy("df").agg(F.sum("n").alias("n")).filter("n <> 0").coalesce(1).write.mode("overwrite").parquet(at("frequencies"))
        shape = lambda name: spark.read.parquet(at(name)).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).head()
        (n, words), (n_gone, words_gone) = shape("docs"), shape("dead")
        version = 1 + max([0, *(r["version"] for r in old)])
        self._commit(old if keep else [], seg, n - n_gone, words - words_gone, buckets, version)

    @staticmethod
    def _rows(corpus: DataFrame) -> DataFrame:
        # in the order of lengths, so that the documents of a range are of like length
        rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).sortWithinPartitions(F.length("text"), "doc_id")
        return rows.select("doc_id", F.lower("text").alias("text")).mapInArrow(counted_words, "doc_id long, dl long, terms array<string>, tfs array<int>")

    @classmethod
    def build(cls, corpus: DataFrame, path: str, buckets: int = BUCKETS) -> KeywordIndex:
        """A new index of ``corpus`` (doc_id, text); a doc_id names one document."""
        index = cls(corpus.sparkSession, path)
        index._segment(0, cls._rows(corpus), index._nothing(), [], buckets, keep=False)
        return index

    def _nothing(self) -> DataFrame:
        return self.spark.range(0).select(F.col("id").alias("doc_id"), F.lit(0).alias("dead_seg"), F.col("id").alias("dl"), F.array(F.lit("")).alias("terms"))

    def _gone(self, ids: DataFrame, segs: list[int]) -> DataFrame:
        live = self._live(segs).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return live.select("doc_id", F.col("seg").cast("int").alias("dead_seg"), "dl", "terms")

    def update(self, corpus: DataFrame) -> None:
        """Documents that are new, or replace those of the same doc_id; what is written grows with them, not with the index."""
        old = self.manifest()
        segs = [r["seg"] for r in old]
        self._segment(max(segs) + 1, self._rows(corpus), self._gone(corpus, segs), old, old[0]["buckets"], keep=True)

    def delete(self, ids: DataFrame) -> None:
        """The documents with these doc_ids count no more."""
        old = self.manifest()
        segs = [r["seg"] for r in old]
        nothing = self.spark.createDataFrame([], "doc_id long, text string")
        self._segment(max(segs) + 1, self._rows(nothing), self._gone(ids, segs), old, old[0]["buckets"], keep=True)

    def compact(self) -> None:
        """All that counts in one segment, made from the stored documents' terms; older versions stay readable."""
        old = self.manifest()
        segs = [r["seg"] for r in old]
        docs = self._live(segs).select("doc_id", "dl", "terms", "tfs").sortWithinPartitions("dl", "doc_id")
        self._segment(max(segs) + 1, docs, self._nothing(), old, old[0]["buckets"], keep=False)

    # reading

    def _entries(self, segs: list[int], blocks: DataFrame) -> DataFrame:
        """The blocks' entries that count, with what else the blocks carry."""
        each = blocks.withColumn("e", F.explode(F.arrays_zip(*ENTRIES))).select(*[c for c in blocks.columns if c not in ENTRIES], F.col("e.doc_ids").alias("doc_id"), F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"))
        if len(segs) == 1:
            return each
        return each.join(self._read("dead", segs).select("doc_id", F.col("dead_seg").alias("seg")), ["doc_id", "seg"], "left_anti")

    def _weights(self, queries: DataFrame, manifest: list) -> DataFrame:
        """query_id, bucket, term, weight: the terms of the queries that the index has."""
        n, segs = sum(r["docs"] for r in manifest), [r["seg"] for r in manifest]
        asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        asked = asked.withColumn("bucket", self._bucket(manifest[0]["buckets"]))
        df = self._read("terms", segs).join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        held = self._read("frequencies", segs).groupBy("df").agg(F.sum("n").alias("n")).filter("n > 0")
        mean = held.agg((F.sum(F.col("n") * _idf(n)) / F.sum("n")).alias("mean"))  # one row
        weighed = asked.join(df.withColumn("idf0", _idf(n)), ["bucket", "term"]).join(F.broadcast(mean))
        return weighed.select("query_id", "bucket", "term", (F.col("qtf") * F.when(F.col("idf0") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf0"))).alias("weight"))

    def statistics(self) -> tuple[DataFrame, DataFrame]:
        """One row each: n_docs and avgdl; n_terms, n_postings, mean_idf and n_negative (terms of negative idf), from how many terms have which df."""
        manifest = self.manifest()
        n = sum(r["docs"] for r in manifest)
        held = self._read("frequencies", [r["seg"] for r in manifest]).groupBy("df").agg(F.sum("n").alias("n")).filter("n > 0").withColumn("idf0", _idf(n))
        terms = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"), F.sum(F.col("n") * F.col("df")).alias("n_postings"), (F.sum(F.col("n") * F.col("idf0")) / F.sum("n")).alias("mean_idf"), F.coalesce(F.sum(F.when(F.col("idf0") < 0, F.col("n"))), F.lit(0)).alias("n_negative"))
        return self.spark.createDataFrame([(n, self._avgdl(manifest))], "n_docs long, avgdl double"), terms

    def postings(self) -> DataFrame:
        """doc_id, term, tf, dl, df and idf: all postings that count."""
        manifest = self.manifest()
        segs, n = [r["seg"] for r in manifest], sum(r["docs"] for r in manifest)
        df = self._read("terms", segs).groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df > 0").withColumn("idf0", _idf(n))
        _, terms = self.statistics()
        stats = df.join(F.broadcast(terms.select("mean_idf"))).select("bucket", "term", "df", F.when(F.col("idf0") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf0")).alias("idf"))
        return self._entries(segs, self._read("postings", segs).select("seg", "bucket", "term", *ENTRIES)).join(stats, ["bucket", "term"]).select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"), "df", "idf")

    def _avgdl(self, manifest: list) -> float:
        return sum(r["words"] for r in manifest) / max(sum(r["docs"] for r in manifest), 1)

    def _scored(self, manifest: list, blocks: DataFrame) -> DataFrame:
        """query_id, doc_id and part, in units of ``1 / SCALE``, of the entries of blocks that carry query_id and weight."""
        hits = self._entries([r["seg"] for r in manifest], blocks)
        return hits.select("query_id", "doc_id", F.floor(_part(F.col("weight"), F.col("tf"), F.col("dl"), self._avgdl(manifest)) * SCALE + 0.5).alias("part"))

    def parts(self, queries: DataFrame, manifest: list | None = None) -> DataFrame:
        """The parts of every document that shares a term with a query."""
        manifest = manifest or self.manifest()
        blocks = self._read("postings", [r["seg"] for r in manifest]).select("seg", "bucket", "term", *ENTRIES)
        return self._scored(manifest, blocks.join(self._weights(queries, manifest), ["bucket", "term"]))

    def scores(self, queries: DataFrame) -> DataFrame:
        """query_id, doc_id and score (six places) of every document that shares a term with a query."""
        return keyword.summed(self.parts(queries))

    def pruned(self, queries: DataFrame, k: int, manifest: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(parts, ranges, rest): the parts of all documents that can be among the k best, all ranges of each query with their bounds, and those read besides the first ``FIRST``."""
        manifest = manifest or self.manifest()
        weights, blocks = self._weights(queries, manifest), self._read("postings", [r["seg"] for r in manifest])
        bound = F.ceil(F.greatest(F.lit(0.0), _part(F.col("weight"), F.col("max_tf"), F.col("min_dl"), self._avgdl(manifest))) * SCALE) + 2
        ranges = blocks.select("seg", "bucket", "term", "range", "max_tf", "min_dl").join(weights, ["bucket", "term"]).groupBy("query_id", "seg", "range").agg(F.sum(bound).alias("bound"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "range")

        def parts(some: DataFrame) -> DataFrame:
            wanted = weights.join(some.select("query_id", "seg", "range"), "query_id")
            return self._scored(manifest, blocks.select("seg", "bucket", "term", "range", *ENTRIES).join(wanted, ["bucket", "term", "seg", "range"]))

        top = ranges.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= FIRST)
        first = parts(top)
        sums = first.groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))
        best = Window.partitionBy("query_id").orderBy(F.desc("part"))
        reached = sums.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k).select("query_id", F.col("part").alias("reached"))
        others = ranges.join(top.select("query_id", "seg", "range"), ["query_id", "seg", "range"], "left_anti").join(reached, "query_id", "left")
        # scores are compared in six places, so what can tie in these is read as well
        rest = others.filter(F.col("reached").isNull() | (F.col("bound") + SCALE // 1_000_000 >= F.col("reached")))
        return first.unionByName(parts(rest)), ranges, rest

    def _asked(self, queries: DataFrame, manifest: list, k: int) -> DataFrame:
        """query_block and asked: the terms of blocks of queries with their weights; a query is in one block, and a partition has no more queries than a task can hold the best of."""
        weights, n = self._weights(queries, manifest), queries.count()
        each = max(1, HELD // (6 * k))
        blocks = F.lit(n // min(QUERY_BLOCK, each) + 1)
        asked = weights.groupBy(F.pmod(F.xxhash64("query_id"), blocks).alias("query_block")).agg(F.sort_array(F.collect_list(F.struct("query_id", "term", "weight"))).alias("asked"))
        return asked.coalesce(n // each + 1)

    def _groups(self, segs: list[int], asked: DataFrame, manifest: list, shared) -> DataFrame:
        """seg, group and blocks: the postings of the terms that are asked for, by groups of ranges."""
        terms = asked.select(F.explode("asked.term").alias("term")).distinct().withColumn("bucket", self._bucket(manifest[0]["buckets"]))
        blocks = self._read("postings", segs).select("seg", "bucket", "range", "term", *ENTRIES).join(shared(terms), ["bucket", "term"], "left_semi")
        if len(segs) > 1:  # without entries that no longer count
            blocks = self._entries(segs, blocks).groupBy("seg", "range", "term").agg(F.collect_list(F.struct("doc_id", "tf", "dl")).alias("e"))
            blocks = blocks.select("seg", "range", "term", *[F.col(f"e.{one}").alias(many) for one, many in zip(("doc_id", "tf", "dl"), ENTRIES, strict=True)])
        return blocks.groupBy("seg", F.floor(F.col("range") / GROUP).alias("group")).agg(F.collect_list(F.struct("term", *ENTRIES)).alias("blocks"))

    def best(self, queries: DataFrame, k: int, manifest: list, always: int = -1, prune: bool = False) -> DataFrame:
        """query_id, doc_id and part, the whole sum, of the k best documents of each query among the groups of ranges that a task meets (ties by doc_id), and, where these are not k above 0, of those up to ``always`` that share a term with it.

        prune: a task passes over groups in which a short query cannot reach the k-th score that the task has found.
        """
        segs, avgdl = [r["seg"] for r in manifest], self._avgdl(manifest)
        asked = self._asked(queries, manifest, k).persist()
        # queries go to all tasks while they are small; beyond that Spark shuffles their terms and pairs their blocks
        chars = queries.agg(F.sum(F.length("query"))).head()[0] or 0
        shared = F.broadcast if chars <= BROADCAST_CHARS else lambda df: df
        if chars > FEW_CHARS and len(segs) == 1:
            docs = self._read("docs", segs).select("doc_id", "dl", "range", "terms", "tfs")
            # no more tasks than a shuffle has, as each gives on its best
            groups = docs.coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(grouped, "seg int, group long, blocks array<struct<term: string, doc_ids: array<long>, tfs: array<int>, dls: array<int>>>")
        else:
            groups = self._groups(segs, asked, manifest, shared)

        def score(batches):
            tops, held = {}, Held(k, always)
            last, group = None, None
            for b in batches:
                for i in range(b.num_rows):
                    of = (b.column("seg")[i].as_py(), b.column("group")[i].as_py())
                    if of != last:  # rows of a group stand together: each meets all blocks of queries in turn
                        last, group = of, Group(_values(b.column("blocks"), i), avgdl)
                    asks = _values(b.column("asked"), i)
                    ids = asks.field("query_id").to_numpy()
                    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                    reached = tops.setdefault(b.column("query_block")[i].as_py(), np.full((len(first), k), -np.inf))
                    found = list(group.best(ids[first], np.r_[first, len(ids)], asks.field("term"), asks.field("weight").to_numpy(), k, always, reached, prune))
                    if found:
                        q, d, p = (np.array([x[0] for x in found], np.int64), [x[1] for x in found], [x[2] for x in found])
                        yield from held.add(np.repeat(q, [len(x) for x in d]), np.concatenate(d), np.concatenate(p))
            yield from held.given()

        pairs = groups.crossJoin(shared(asked))
        return pairs.mapInArrow(score, "query_id long, doc_id long, part long")

    def search(self, queries: DataFrame, k: int, min_score: float = 0.0, prune: bool = False) -> DataFrame:
        """The k best documents of each query (query_id, query) with a score of ``min_score`` or more, ties by doc_id, as ``keyword.bm25_top`` gives them."""
        queries, manifest = keyword.not_blank(queries), self.manifest()
        least = self._live([r["seg"] for r in manifest]).select("doc_id").orderBy("doc_id").limit(2 * k).persist()
        always = least.agg(F.max("doc_id")).head()[0] if min_score <= 0 else None
        always = -1 if always is None else always
        parts = self.best(queries, k, manifest, always, prune)
        if min_score <= 0:  # documents without a common word fill up short lists
            parts = parts.unionByName(queries.select("query_id").distinct().join(F.broadcast(least)).withColumn("part", F.lit(0).cast("long")))
        # by queries once: sums and ranks need no other shuffle
        return keyword.ranked(keyword.summed(parts.repartition("query_id")).filter(F.col("score") >= min_score), k)
