"""Chunkers: one row of text in, a row for each chunk out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOPS = (". ", ".\n", "!\n", "?\n")


def spans(text: str, most: int = 2000, overlap: int = 150) -> Iterator[tuple[int, int]]:
    """Begin and end of each overlapping chunk: it ends at a blank line or a sentence in its second half, if there is one.

    A text of at most ``most`` characters is one chunk.
    """
    n = len(text)
    if n <= most:
        yield 0, n
        return
    begin = 0
    while begin < n:
        end = begin + most
        if end < n:
            half = begin + most // 2
            if (cut := text.rfind("\n\n", begin, end)) > half:
                end = cut
            elif (cut := max(text.rfind(s, begin, end) for s in STOPS)) > half:
                end = cut + 1
        yield begin, min(end, n)
        begin = max(begin + 1, end - overlap)


def semantic_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 2000, overlap: int = 150) -> DataFrame:
    """key, part_number, total_parts, has_overlap, chunk_order, begin, end and text of each chunk; null texts have none."""
    if not 500 <= most <= 10_000:
        raise ValueError("chunks have 500 to 10,000 characters")

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t is None:
                    continue
                cut = list(spans(t, most, overlap))
                rows += [(k, i + 1, len(cut), i > 0, i, x, y, t[x:y].strip()) for i, (x, y) in enumerate(cut)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=[key, "part_number", "total_parts", "has_overlap", "chunk_order", "begin", "end", "chunk"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, part_number int, total_parts int, has_overlap boolean, chunk_order int, begin int, end int, chunk string")


def fixed_chunks(text: Column, width: int = 1200) -> Column:
    """Slices of a text without overlap; of an empty text, none."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(width)), lambda i: F.substring(text, i + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def paragraph_chunks(text: Column, by: str = "\n\n", most: int = 1200) -> Column:
    """Paragraphs packed while their lengths add up to ``most`` at the most; a longer one stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, p: Column) -> Column:
        fits = acc["open"].isNull() | (acc["size"] + F.length(p) <= most)
        done = F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        text_ = F.when(acc["open"].isNull() | ~fits, p).otherwise(F.concat(acc["open"], F.lit(by), p))
        size = F.when(fits, acc["size"] + F.length(p)).otherwise(F.length(p))
        return F.struct(done.alias("done"), text_.alias("open"), size.alias("size"))

    end = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    return F.aggregate(F.filter(F.split(text, by), lambda p: F.trim(p) != ""), start, step, end)
