"""Layout of parsed PDF pages: blocks (doc_id, page, ordinal, text, font_size) to typed blocks, tables and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import any_of, trim_ws

#: Parameter sets by kind of document.
PROFILES = {
    "default": {"chunk_words": 500, "overlap_words": 50},
    "technical": {"chunk_words": 600, "overlap_words": 80},
    "academic": {"chunk_words": 800, "overlap_words": 100},
    "manual": {"chunk_words": 400, "overlap_words": 50},
    "presentation": {"chunk_words": 200, "overlap_words": 20},
}


def profile(name: str) -> dict[str, int]:
    if name not in PROFILES:
        raise ValueError(f"no such profile: {name}")
    return PROFILES[name]


def heading_level(size: Column) -> Column:
    return F.when(size >= 18, 1).when(size >= 14, 2).when(size >= 12, 3).otherwise(4)


def block_kind(text: Column, size: Column) -> Column:
    """heading, list_item, note, table_row or paragraph, in this order."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / F.greatest(F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.lit(1))
    heading = ((size >= 14) & (words <= 15)) | text.rlike(r"^(?:Chapter|Section|Appendix)\s+\w+") | text.rlike(r"^\d+(?:\.\d+)*\s+\p{Lu}") & (words <= 12) | (upper > 0.7) & (words <= 10) & (F.length(text) > 3)
    return (
        F.when(heading, "heading")
        .when(text.rlike(r"^\s*(?:[-•*]|\d+[.)])\s+"), "list_item")
        .when(text.rlike(r"(?i)^\s*(?:note|warning|tip|caution|important)\b"), "note")
        .when(text.rlike(r"\S\s{3,}\S|\t|\|"), "table_row")
        .otherwise("paragraph")
    )


def typed(blocks: DataFrame) -> DataFrame:
    """Blocks of five characters or more with kind and level."""
    kept = blocks.filter(F.length(F.trim("text")) >= 5)
    return kept.withColumn("kind", block_kind(F.col("text"), F.col("font_size"))).withColumn("level", F.when(F.col("kind") == "heading", heading_level(F.col("font_size"))))


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a table with a rule below its head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


#: Words and signs of a line that tells a shortcut.
SHORTCUT = ("HOME", "ALT", "CTRL", "LEFT", "RIGHT", "UP", "DOWN", "Middle", "mouse", "drag", "+", "-")


def _share(lines: Column, good) -> Column:
    return F.size(F.filter(lines, good)) / F.size(lines)


def is_shortcut_table(lines: Column) -> Column:
    """Three lines or more, over 60 % of them with a key or a mouse action."""
    named = lambda x: any_of(x, SHORTCUT, lower=True)
    return (F.size(lines) >= 3) & (_share(lines, named) > 0.6)


def is_table(lines: Column, lefts: Column) -> Column:
    """Three lines or more that mostly end in a key-like word, or that begin at two places at most and are mostly short."""
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")

    def key_like(x: Column) -> Column:
        last = F.element_at(words(x), -1)
        upper = (last == F.upper(last)) & (last != F.lower(last)) & (F.length(last) <= 15)
        return F.when(F.size(words(x)) >= 2, upper | last.rlike("^(?:[A-Z]+|[+-])$")).otherwise(False)

    aligned = (F.size(F.array_distinct(lefts)) <= 2) & (_share(lines, lambda x: F.size(words(x)) <= 5) > 0.5)
    return (F.size(lines) >= 3) & ((_share(lines, key_like) > 0.7) | aligned)


def chunk_text(blocks: Column) -> Column:
    """The text of blocks (structs of kind and text, in order): list items one below the other, all else apart by a blank line."""

    def put(b: Column) -> Column:
        before = F.when(b["kind"] == "list_item", "\n").otherwise("\n\n")
        after = F.when(b["kind"].isin("heading", "note"), "\n").when(b["kind"] == "table", "\n\n").otherwise("")
        return F.concat(before, b["text"], after)

    return F.regexp_replace(trim_ws(F.array_join(F.transform(blocks, put), "")), "\n{3,}", "\n\n")


def attach_tables(blocks: DataFrame, tables: DataFrame, swallow: int = 3) -> DataFrame:
    """The k-th table of a page takes the place of the k-th free table row, and the next three rows of the page go.

    A page is a small group; rows are numbered in it, so every fourth one is free.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("ordinal")
    rows = blocks.filter("kind = 'table_row'").withColumn("nth", F.row_number().over(page) - 1)
    rows = rows.withColumn("k", F.floor(F.col("nth") / (swallow + 1)).cast("int")).withColumn("head", F.col("nth") % (swallow + 1) == 0)
    t = tables.select("doc_id", "page", F.col("table_index").alias("k"), "table_markdown")
    joined = rows.join(t, ["doc_id", "page", "k"], "left").filter("head OR table_markdown IS NULL")
    joined = joined.withColumn("text", F.coalesce("table_markdown", "text")).drop("nth", "k", "head", "table_markdown")
    return blocks.filter("kind <> 'table_row'").unionByName(joined)


def attach_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """chunk_id, image_id: images on the pages of a chunk."""
    pages = chunks.select("doc_id", "chunk_id", F.explode("pages").alias("page"))
    return pages.join(images, ["doc_id", "page"]).select("chunk_id", "image_id").distinct()


class RunningChunks:
    """Chunks of one document's blocks, which come one after the other in the order of pages.

    A heading ends a chunk of more than ``least`` words (a shorter one goes on
    under it), ``chunk_words`` end one anywhere, and its last ``overlap_words``
    begin the next.  What is held is the chunk that is open.
    """

    def __init__(self, least: int = 50):
        self.least, self.made = least, 0
        self.buffer: list[str] = []
        self.pages: set[int] = set()
        self.words, self.title = 0, ""

    def _cut(self, overlap_words: int | None) -> tuple:
        out = (self.made, self.title, "\n".join(self.buffer), sorted(self.pages), self.words)
        self.made += 1
        if overlap_words is None:  # a heading or the end: nothing goes on
            self.pages.clear()
        tail = " ".join(self.buffer).split()[-overlap_words:] if overlap_words else []
        # a chunk in the middle of a section goes on with its last words, be there any
        self.buffer, self.words = [" ".join(tail)] if overlap_words else [], len(tail)
        return out

    def _open(self, keep_short: bool) -> bool:
        return self.words > self.least or (keep_short and self.words > 0)

    def add(self, kind: str, text: str | None, page: int, chunk_words: int, overlap_words: int, keep_short: bool):
        text = (text or "").strip()
        if kind == "heading":
            if self._open(keep_short):
                yield self._cut(None)
            self.title = text
            return
        self.buffer.append(text)
        self.pages.add(int(page))
        self.words += len(text.split())
        if self.words >= chunk_words:
            yield self._cut(overlap_words)

    def end(self, keep_short: bool):
        if self._open(keep_short):
            yield self._cut(None)


@F.udtf(returnType="doc_id long, chunk_id int, title string, text string, pages array<int>, words int")
class PdfChunks:
    """Chunks of typed blocks, a document in each partition and its blocks in order: one pass, whatever its length."""

    def __init__(self):
        self.running, self.doc, self.keep_short = RunningChunks(), None, False

    def eval(self, row, chunk_words: int, overlap_words: int, keep_short: bool):
        self.doc, self.keep_short = row["doc_id"], keep_short
        for made in self.running.add(row["kind"], row["text"], row["page"], chunk_words, overlap_words, keep_short):
            yield (self.doc, *made)

    def terminate(self):
        for made in self.running.end(self.keep_short):
            yield (self.doc, *made)


def chunks(blocks: DataFrame, name: str = "default", keep_short: bool = False) -> DataFrame:
    """doc_id, chunk_id, title, text, pages and words of the chunks of typed blocks."""
    p = profile(name)
    table = blocks.select("doc_id", "page", "ordinal", "kind", "text").asTable().partitionBy("doc_id").orderBy("page", "ordinal")
    return PdfChunks(table, F.lit(p["chunk_words"]), F.lit(p["overlap_words"]), F.lit(keep_short))
