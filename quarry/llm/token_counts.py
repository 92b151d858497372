"""Token counts that follow edits.

A document's pieces (runs of text at whose edges the vocabulary's pattern always
breaks) are the leaves of a segment tree that holds bytes and tokens of each
subtree.  An edit finds its leaves by a descent over bytes, takes one leaf on
either side as context, re-encodes that region alone, and renews the sums on
the way to the root.  A leaf that takes up its neighbours' text holds the sum
of all its pieces; emptied leaves hold zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, tokens, work


class PieceTree:
    """Bytes and tokens of a document's pieces."""

    def __init__(self, text: bytes, encoder: tokens.WordEncoder):
        self.encoder = encoder
        size, count, self.encoded = self._measure(text)
        self.leaves = max(1, len(size))
        self.width = 1 << (self.leaves - 1).bit_length()
        self.size, self.count = (np.zeros(2 * self.width, np.int64) for _ in range(2))
        self.size[self.width : self.width + len(size)] = size
        self.count[self.width : self.width + len(count)] = count
        for tree in (self.size, self.count):
            level = self.width
            while level > 1:
                tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
                level //= 2
        self.text = text
        #: Texts of leaves that an edit has touched.
        self.changed: dict[int, bytes] = {}

    def _measure(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        pieces = self.encoder.pieces(text)
        ids = self.encoder.ids_of(pieces)
        # a piece stands for itself after a mark, or for itself after a blank
        size = np.array([len(p) - 1 if p[:1] == tokens.MARK else len(p) + 1 for p in pieces], np.int64)
        return size, np.array([len(x) // 4 for x in ids], np.int64), len(pieces)

    @property
    def tokens(self) -> int:
        return int(self.count[1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds byte ``at`` (the last one with text beyond the end), and its first byte."""
        node, begin = 1, 0
        at = min(at, max(int(self.size[1]) - 1, 0))
        while node < self.width:
            node *= 2
            if at - begin >= self.size[node] and self.size[node + 1]:
                begin += int(self.size[node])
                node += 1
        return node - self.width, begin

    def _set(self, leaf: int, size: int, count: int) -> None:
        node = leaf + self.width
        self.size[node], self.count[node] = size, count
        while node > 1:
            node //= 2
            self.size[node] = self.size[2 * node] + self.size[2 * node + 1]
            self.count[node] = self.count[2 * node] + self.count[2 * node + 1]

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Replace bytes begin to end of the present text; the number of pieces encoded anew."""
        total = int(self.size[1])
        begin, end = min(begin, total), min(max(begin, end), total)
        first, lo = self._leaf(begin)
        if lo:
            first, lo = self._leaf(lo - 1)
        last, at = self._leaf(max(begin, end))
        hi = at + int(self.size[last + self.width])
        if hi < total:
            last, at = self._leaf(hi)
            hi = at + int(self.size[last + self.width])
        region = self.text[lo:begin] + new + self.text[end:hi]
        if self.encoder.special(region):  # an added token may have come about, which changes how all around it is cut
            first, last, lo, hi = 0, self.leaves - 1, 0, total
            region = self.text[:begin] + new + self.text[end:]
        self.text = self.text[:begin] + new + self.text[end:]
        size, count, pieces = self._measure(region)
        for leaf in range(first + 1, last + 1):
            if self.size[leaf + self.width]:
                self._set(leaf, 0, 0)
        self._set(first, len(region), int(count.sum()))
        return pieces


def count_with_edits(docs: DataFrame, edits: Column, vocabulary: str, spaced: bool = True) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, n_pieces and n_recounted of each row of ``docs``.

    ``edits``: array of struct(begin, end, text), code points of the text before
    any edit, in ascending order without overlaps; null: none.  A null text is
    empty; places beyond the end count as the end.
    """

    def run(batches):
        encoder = tokens.WordEncoder.of(vocabulary, spaced)
        for s in blocks.slices(batches):
            rows = []
            for i, (doc_id, changes) in enumerate(zip(s.rows.column("doc_id").to_pylist(), s.rows.column("edits").to_pylist(), strict=True)):
                text = s.text(i)
                tree = PieceTree(text, encoder)
                before, again = tree.tokens, 0
                chars = text.decode()
                for e in reversed(changes or []):  # from the end, so that earlier places hold
                    b, z = min(e["begin"], len(chars)), min(max(e["begin"], e["end"]), len(chars))
                    again += tree.edit(len(chars[:b].encode()), len(chars[:z].encode()), (e["text"] or "").encode())
                rows.append((doc_id, before, tree.tokens, tree.encoded, again))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "n_tokens", "edited_tokens", "n_pieces", "n_recounted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), edits.alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, edited_tokens long, n_pieces long, n_recounted long")


def three_edits(text: Column, inserted: Column) -> Column:
    """Five code points go at a quarter, ten give way to a word at the half, the word is put in at three quarters.

    A short text loses no more than what lies before the next place; an empty or null text has no edits.
    """
    n = F.length(text)
    place = lambda k: F.floor(n * k / 4).cast("int")
    one = lambda k, size, new: F.struct(place(k).alias("begin"), (place(k) + F.least(F.lit(size), place(k + 1) - place(k))).alias("end"), new.alias("text"))
    word = F.coalesce(inserted, F.lit(""))
    return F.when(n > 0, F.array(one(1, 5, F.lit("")), one(2, 10, word), one(3, 0, word)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every document of ``documents`` before and after three edits (its source as the new text)."""
    docs = work.read_documents(spark, sf_dir)
    return count_with_edits(docs, three_edits(F.col("text"), F.col("source").cast("string")), tokens.vocabulary("byte_bpe_50k.json"))
