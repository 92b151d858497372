"""Queries of chunking and of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking
from quarry.sources.tables import LIBRARY_SQL, library, table

from .registry import query

RFIND = "coalesce(CASE WHEN instr(reverse(w), reverse({0})) > 0 THEN st + length(w) - (instr(reverse(w), reverse({0})) - 1) - length({0}) END, -1)"
STOPS = ", ".join(RFIND.format(x) for x in ("'. '", "'.' || chr(10)", "'!' || chr(10)", "'?' || chr(10)"))
#: The chunk loop as a recursion: part, start, window.
CHUNKS = f"""RECURSIVE r AS (SELECT doc_id, text, 0 AS i, 0 AS st, substring(text, 1, 2000) AS w FROM documents
  UNION ALL SELECT doc_id, text, i + 1, nxt, substring(text, nxt + 1, 2000) FROM (SELECT doc_id, text, i, greatest(st + 1, CASE WHEN length(text) <= 2000 THEN length(text) + 150
    WHEN st + 2000 >= length(text) THEN st + 2000 WHEN {RFIND.format("chr(10) || chr(10)")} > st + 1000 THEN {RFIND.format("chr(10) || chr(10)")}
    WHEN greatest({STOPS}) > st + 1000 THEN greatest({STOPS}) + 1 ELSE st + 2000 END - 150) AS nxt FROM r) WHERE nxt < length(text)),
e AS (SELECT doc_id, text, i, st, CASE WHEN st + 2000 >= length(text) THEN length(text) WHEN {RFIND.format("chr(10) || chr(10)")} > st + 1000 THEN {RFIND.format("chr(10) || chr(10)")}
    WHEN greatest({STOPS}) > st + 1000 THEN greatest({STOPS}) + 1 ELSE st + 2000 END AS en FROM r),
chunks AS (SELECT doc_id, i, st, en, regexp_replace(substring(text, st + 1, en - st), '^\\s+|\\s+$', '', 'g') AS chunk, count(*) OVER (PARTITION BY doc_id) AS parts FROM e)"""


def parts(spark, sf_dir) -> DataFrame:
    return chunking.semantic_chunks(table(spark, sf_dir, "documents"))


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(i + 1 AS INT) AS part_number, CAST(parts AS INT) AS total_parts, i > 0 AS has_overlap, CAST(i AS INT) AS chunk_order, CAST(st AS INT) AS \"begin\", CAST(en AS INT) AS \"end\", sha256(chunk) AS content_hash FROM chunks")
def chunk_parts(spark, sf_dir):
    return parts(spark, sf_dir).withColumn("content_hash", F.sha2("chunk", 256)).drop("chunk")


@query(f"""WITH {CHUNKS} SELECT doc_id, CAST(i AS INT) AS chunk_order, chunk, sha256(chunk) AS content_hash, CASE WHEN contains(chunk, '<code>') OR contains(chunk, '<pre>') THEN 'code' ELSE 'text' END AS content_type,
 len(list_filter(regexp_split_to_array(chunk, '\\s+'), lambda x: x <> '')) AS words, CAST(greatest(1, length(chunk) // 4) AS BIGINT) AS tokens FROM chunks""")
def chunks_table(spark, sf_dir):
    """The chunk table as it is appended: text, hash, order, kind, path and counts."""
    c = parts(spark, sf_dir)
    return c.select("doc_id", "chunk_order", "chunk", F.sha2("chunk", 256).alias("content_hash"), T.content_type(F.col("chunk"), F.lit(2)).alias("content_type"), T.word_count(F.col("chunk")).alias("words"), T.estimate_tokens(F.col("chunk")).alias("tokens"))


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, CAST(sum(greatest(1, length(chunk) // 4)) AS BIGINT) AS tokens FROM chunks GROUP BY doc_id")
def doc_totals(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk").cast("long")).alias("chars"), F.sum(T.estimate_tokens(F.col("chunk"))).alias("tokens"))


@query(f"WITH {CHUNKS}, {LIBRARY_SQL} SELECT c.doc_id, CAST(i AS INT) AS chunk_order, title, source, length(chunk) AS n FROM chunks c JOIN lib USING (doc_id) WHERE status = 'completed' AND source IN ('src5', 'src6')")
def chunk_doc_join(spark, sf_dir):
    lib = library(spark, sf_dir).filter((F.col("status") == "completed") & F.col("source").isin("src5", "src6")).select("doc_id", "title", "source")
    return parts(spark, sf_dir).join(lib, "doc_id").select("doc_id", "chunk_order", "title", "source", F.length("chunk").cast("long").alias("n"))


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(i AS INT) AS chunk_order, sha256(chunk) AS content_hash FROM chunks WHERE i >= 1 AND i < 4")
def page_chunks(spark, sf_dir):
    """The second to fourth chunk of every document: a page of its chunks in order."""
    return parts(spark, sf_dir).filter(F.col("chunk_order").between(1, 3)).select("doc_id", "chunk_order", F.sha2("chunk", 256).alias("content_hash"))


@query(f"WITH {CHUNKS} SELECT doc_id, list(sha256(chunk) ORDER BY i) AS chunk_hashes, count(*) AS total FROM chunks GROUP BY doc_id")
def export_chunks(spark, sf_dir):
    """One row a document with its chunks in order, as it is exported."""
    c = parts(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_order", F.sha2("chunk", 256).alias("h")))).alias("c"), F.count("*").alias("total"))
    return c.select("doc_id", F.transform("c", lambda x: x["h"]).alias("chunk_hashes"), "total")


@query(f"WITH {CHUNKS} SELECT round(avg(len(list_filter(regexp_split_to_array(chunk, '\\s+'), lambda x: x <> ''))), 6) AS avg_words, count(*) AS n_chunks FROM chunks")
def avg_chunk_words(spark, sf_dir):
    return parts(spark, sf_dir).agg(F.round(F.avg(T.word_count(F.col("chunk"))), 6).alias("avg_words"), F.count("*").alias("n_chunks"))


@query(f"""WITH {CHUNKS}, k AS (SELECT CASE WHEN parts = 1 THEN 'complete' WHEN i = 0 THEN 'first' ELSE 'part' END AS kind FROM chunks)
SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM k GROUP BY kind""")
def type_distribution(spark, sf_dir):
    kind = F.when(F.col("total_parts") == 1, "complete").when(F.col("chunk_order") == 0, "first").otherwise("part")
    n = parts(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row for three kinds
    return n.join(F.broadcast(total)).select("kind", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


@query("SELECT doc_id, CAST(i AS INT) AS part, substring(text, i * 1200 + 1, 1200) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1199) // 1200)) AS i FROM documents)")
def fixed_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.fixed_chunks(F.col("text"))).alias("part", "chunk"))


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ps FROM documents),
g AS (SELECT doc_id, ps, 1 AS i, 0 AS grp, length(ps[1]) AS size FROM p WHERE len(ps) > 0
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN size + length(ps[i + 1]) <= 1200 THEN grp ELSE grp + 1 END, CASE WHEN size + length(ps[i + 1]) <= 1200 THEN size + length(ps[i + 1]) ELSE length(ps[i + 1]) END FROM g WHERE i < len(ps))
SELECT doc_id, CAST(grp AS INT) AS part, string_agg(ps[i], chr(10) ORDER BY i) AS chunk FROM g GROUP BY doc_id, grp""")
def paragraph_chunks(spark, sf_dir):
    """Lines stand for paragraphs: the documents have no blank lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.paragraph_chunks(F.col("text"), "\n")).alias("part", "chunk"))


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(i AS INT) AS chunk_order, sha256('# Document ' || doc_id || CASE WHEN parts > 1 THEN ' (Part ' || (i + 1) || '/' || parts || ')' ELSE '' END || chr(10) || chr(10) || chunk) AS content_hash FROM chunks")
def chunk_headers(spark, sf_dir):
    """Chunks below the headings that searches see."""
    text = T.chunk_with_header(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("chunk"), F.col("part_number"), F.col("total_parts"))
    return parts(spark, sf_dir).select("doc_id", "chunk_order", F.sha2(text, 256).alias("content_hash"))
