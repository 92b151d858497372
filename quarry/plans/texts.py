"""Queries of text functions: cleaning, statistics, prompts and what models reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.prompts import TEMPLATES, attributed, chat, numbered, prompt, with_history
from quarry.operators import fusion
from quarry.sources.store import documents_index
from quarry.sources.tables import LIBRARY_SQL, library, table

from .registry import query
from .retrieval import BM25, RELEVANCE, corpus, questions, settled

WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
NOISE_SQL = " OR ".join(f"contains(l, '{p}')" for p in T.NOISE)
DANGER_SQL = " OR ".join("contains(lower(text), '" + p.lower() + "')" for p in T.DANGEROUS)
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {TRIM.format('l')}),
 lambda l: length(l) >= 3 AND NOT (({NOISE_SQL}) AND length(l) < 100) AND length(regexp_replace(l, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(l) <= 0.5), chr(10)) AS cleaned FROM documents""")
def clean_text_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, length(text) AS chars, CAST(len({WORDS.format('text')}) AS BIGINT) AS words, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def chunk_stats(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars"), T.word_count(F.col("text")).alias("words"), T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Chunk ' || doc_id WHEN source <> '' AND source <> lang THEN lang || ' > ' || source ELSE lang END AS path FROM documents""")
def section_path(spark, sf_dir):
    """Documents of every fifth id stand for chunks without a hierarchy."""
    h = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(T.hierarchy(F.col("lang"), F.col("source")))
    return docs(spark, sf_dir).select("doc_id", T.section_path(h, F.col("doc_id").cast("string")).alias("path"))


@query("SELECT doc_id, sha256(text) AS content_hash, length(text) AS n FROM documents")
def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, length({TRIM.format('text')}) >= 20 AS section_ok, length({TRIM.format('text')}) >= 30 AS sync_ok, length({TRIM.format('text')}) >= 50 AS async_ok, length({TRIM.format('text')}) >= 10 AS chunk_ok FROM documents")
def min_content(spark, sf_dir):
    n = F.length(T.trim_ws(F.col("text")))
    return docs(spark, sf_dir).select("doc_id", (n >= 20).alias("section_ok"), (n >= 30).alias("sync_ok"), (n >= 50).alias("async_ok"), (n >= 10).alias("chunk_ok"))


@query("SELECT page_id, CASE WHEN contains(html, '<code>') OR contains(html, '<pre>') THEN 'code' WHEN page_id % 3 + 1 = 1 THEN 'heading' ELSE 'text' END AS content_type FROM pages")
def content_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.content_type(F.col("html"), F.col("page_id") % 3 + 1).alias("content_type"))


@query(r"SELECT page_id, regexp_matches(html, '\{[^}]*\}') OR regexp_matches(html, 'function\s*\(') OR regexp_matches(html, 'class\s+\w+') OR regexp_matches(html, 'def\s+\w+') AS has_code FROM pages")
def code_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.looks_like_code(F.col("html")).alias("has_code"))


@query(f"SELECT doc_id, array_to_string({WORDS.format('text')}[-20:], ' ') AS tail FROM documents")
def overlap_tail(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.overlap_tail(F.col("text"), 20).alias("tail"))


@query(f"SELECT conv_id, turn, length(text) <= 1000 AND NOT ({DANGER_SQL}) AS safe FROM conversations")
def input_screen(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.safe_input(F.col("text")).alias("safe"))


@query(r"""SELECT page_id, regexp_replace(string_split(string_split(url, '/')[-1], '\')[-1], '[<>:"|?*]', '_', 'g') AS name FROM pages""")
def sanitize_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_file_name(F.col("url")).alias("name"))


@query(f"WITH {LIBRARY_SQL} SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULLIF(text, '') END, NULLIF(CASE WHEN doc_id % 3 = 1 THEN title END, ''), file_name) AS content FROM lib")
def coalesce_text(spark, sf_dir):
    content, text = F.when(F.col("doc_id") % 3 == 0, F.col("text")), F.when(F.col("doc_id") % 3 == 1, F.col("title"))
    return library(spark, sf_dir).select("doc_id", F.coalesce(F.nullif(content, F.lit("")), F.nullif(text, F.lit("")), "file_name").alias("content"))


#: Replies as a model might give them, made from the benchmark texts.
REPLY = "'Here are some queries:' || chr(10) || '1. ' || text || chr(10) || '- \"' || left(text, 60) || '\"' || chr(10) || 'ok' || chr(10) || '2) ' || left(text, 90)"


def replies(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    reply = F.concat(F.lit("Here are some queries:\n1. "), t, F.lit('\n- "'), F.substring(t, 1, 60), F.lit('"\nok\n2) '), F.substring(t, 1, 90))
    return table(spark, sf_dir, "benchmark").select("item_id", reply.alias("reply"))


LINES = f"list_filter(list_transform(string_split({TRIM.format('reply')}, chr(10)), lambda l: {TRIM.format('l')}), lambda l: l <> '' AND NOT regexp_matches(lower(l), 'alternative|query:|queries:|example:|original:|here are|generated'))"
BARE = f"list_filter(list_transform({LINES}, lambda l: regexp_replace(regexp_replace(regexp_replace(l, '^\\d+[.)]\\s*', ''), '^[-•*]\\s*', ''), '^[\"'']+|[\"'']+$', '', 'g')), lambda l: length(l) BETWEEN 5 AND 200)"


@query(f"""WITH r AS (SELECT item_id, {REPLY} AS reply FROM benchmark), b AS (SELECT item_id, reply, {BARE}[1:3] AS found FROM r),
p AS (SELECT item_id, found, list_filter(list_transform(string_split(reply, chr(10)), lambda l: regexp_replace({TRIM.format('l')}, '^["'']+|["'']+$', '', 'g')), lambda l: length(l) BETWEEN 5 AND 200)[1:3] AS parts FROM b)
SELECT item_id, CASE WHEN len(found) > 0 THEN found ELSE parts END AS queries FROM p""")
def parse_expansions(spark, sf_dir):
    return replies(spark, sf_dir).select("item_id", T.expansions_of(F.col("reply"), 3).alias("queries"))


@query(f"""WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN turn || '/10 good' WHEN 1 THEN '12' WHEN 2 THEN '-1 x' ELSE text END AS reply FROM conversations)
SELECT conv_id, turn, CASE WHEN g IS NULL THEN 5.0 ELSE greatest(0.0, least(10.0, g)) END AS grade FROM (SELECT conv_id, turn, TRY_CAST(string_split(regexp_split_to_array({TRIM.format('reply')}, '\\s+')[1], '/')[1] AS DOUBLE) AS g FROM r)""")
def parse_relevance(spark, sf_dir):
    t = F.col("turn")
    reply = F.when(t % 4 == 0, F.concat(t.cast("string"), F.lit("/10 good"))).when(t % 4 == 1, "12").when(t % 4 == 2, "-1 x").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_relevance(reply).alias("grade"))


CITING = "text || ' [' || turn || '] [2] [2] [Source ' || (turn + 1) || '] (Source: Guide) [9]'"
CITED = r"list_concat(regexp_extract_all(r, '\[(\d+)\]', 1), regexp_extract_all(r, '\[Source (\d+)\]', 1), regexp_extract_all(r, '\(Source:\s*([^)]+)\)', 1))"
ORDERED = f"list_filter({CITED}, lambda x, i: list_position({CITED}, x) = i)"


def citing(spark, sf_dir) -> DataFrame:
    t = F.col("turn")
    r = F.concat("text", F.lit(" ["), t.cast("string"), F.lit("] [2] [2] [Source "), (t + 1).cast("string"), F.lit("] (Source: Guide) [9]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.alias("r"))


@query(f"WITH c AS (SELECT conv_id, turn, {CITING} AS r FROM conversations) SELECT conv_id, turn, {ORDERED} AS citations FROM c")
def extract_citations(spark, sf_dir):
    return citing(spark, sf_dir).select("conv_id", "turn", T.citations(F.col("r")).alias("citations"))


@query(f"""WITH c AS (SELECT conv_id, turn, {CITING} AS r FROM conversations), x AS (SELECT conv_id, turn, {ORDERED} AS citations FROM c)
SELECT conv_id, turn, len(citations) > 0 AS has_citations, CAST(len(citations) AS INT) AS num_citations, len(citations) = 3 AS all_sources_cited,
 list_filter(citations, lambda x: TRY_CAST(x AS INT) IS NOT NULL AND (TRY_CAST(x AS INT) < 1 OR TRY_CAST(x AS INT) > 3)) AS invalid FROM x""")
def validate_citations(spark, sf_dir):
    c = citing(spark, sf_dir).withColumn("c", T.citations(F.col("r")))
    return c.select("conv_id", "turn", (F.size("c") > 0).alias("has_citations"), F.size("c").alias("num_citations"), (F.size("c") == 3).alias("all_sources_cited"), T.invalid_citations(F.col("c"), F.lit(3)).alias("invalid"))


#: A reply that quotes a text, or says that it found nothing.
QUOTING = "CASE WHEN turn % 3 = 0 THEN 'Information not available: ' || text ELSE '\"' || replace(left(text, 40), '\"', '') || '\" (Source: Guide ' || turn || ', Page 4) \"x\" (Source: Other)' END"


@query(f"""WITH c AS (SELECT conv_id, turn, {QUOTING} AS r FROM conversations), f AS (SELECT *, NOT regexp_matches(lower(r), 'information not available|no relevant information|not found in the context|cannot find') AS has_answer FROM c)
SELECT conv_id, turn, has_answer, CASE WHEN has_answer THEN regexp_extract_all(r, '"([^"]+)"', 1) ELSE [] END AS quotes,
 CASE WHEN has_answer THEN regexp_extract_all(r, '\\(Source:\\s*([^,)]+)(?:,\\s*Page\\s*([^)]+))?\\)', 1) ELSE [] END AS sources,
 list_transform(CASE WHEN has_answer THEN regexp_extract_all(r, '\\(Source:\\s*([^,)]+)(?:,\\s*Page\\s*([^)]+))?\\)', 2) ELSE [] END, lambda x: coalesce(x, '')) AS pages FROM f""")
def parse_extractive(spark, sf_dir):
    t = F.col("turn")
    quoted = F.concat(F.lit('"'), F.replace(F.substring("text", 1, 40), F.lit('"'), F.lit("")), F.lit('" (Source: Guide '), t.cast("string"), F.lit(', Page 4) "x" (Source: Other)'))
    r = F.when(t % 3 == 0, F.concat(F.lit("Information not available: "), "text")).otherwise(quoted)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", r.alias("r"))
    has = ~T.any_of(F.col("r"), ("information not available", "no relevant information", "not found in the context", "cannot find"), lower=True)
    none = F.array().cast("array<string>")
    source = r"\(Source:\s*([^,)]+)(?:,\s*Page\s*([^)]+))?\)"
    found = lambda p, k: F.when(F.col("has_answer"), F.regexp_extract_all("r", F.lit(p), F.lit(k))).otherwise(none)
    return c.withColumn("has_answer", has).select("conv_id", "turn", "has_answer", found('"([^"]+)"', 1).alias("quotes"), found(source, 1).alias("sources"), found(source, 2).alias("pages"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct({WORDS.format('lower(text)')}) AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
o AS (SELECT conv_id, turn, a, list_distinct({WORDS.format("lower(coalesce(prev, ''))")}) AS c FROM w)
SELECT conv_id, turn, CAST(len(list_intersect(a, c)) AS INT) AS common, round(len(list_intersect(a, c)) / greatest(len(a), 1), 6) AS ratio, len(a) > 0 AND len(c) > 0 AND len(list_intersect(a, c)) / greatest(len(a), 1) >= 0.8 AS extractive FROM o""")
def extractive_overlap(spark, sf_dir):
    """Each message as an answer, the one before as its context."""
    c = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    c = c.select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("a"), F.array_distinct(T.tokens(F.col("prev"))).alias("c")).withColumn("common", F.size(F.array_intersect("a", "c")))
    ratio = F.col("common") / F.greatest(F.size("a"), F.lit(1))
    return c.select("conv_id", "turn", "common", F.round(ratio, 6).alias("ratio"), ((F.size("a") > 0) & (F.size("c") > 0) & (ratio >= 0.8)).alias("extractive"))


@query(f"""WITH v AS (SELECT item_id, 0 AS ord, text AS q FROM benchmark UNION ALL SELECT item_id, 1, lower(text) FROM benchmark UNION ALL SELECT item_id, 2, '  ' || text || ' ' FROM benchmark UNION ALL SELECT item_id, 3, left(text, 30) FROM benchmark),
r AS (SELECT item_id, ord, q, row_number() OVER (PARTITION BY item_id, lower({TRIM.format('q')}) ORDER BY ord) AS n FROM v) SELECT item_id, ord, q FROM r WHERE n = 1""")
def query_dedup(spark, sf_dir):
    t = F.col("text")
    v = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(t, F.lower(t), F.concat(F.lit("  "), t, F.lit(" ")), F.substring(t, 1, 30))).alias("ord", "q"))
    order = Window.partitionBy("item_id", F.lower(T.trim_ws(F.col("q")))).orderBy("ord")
    return v.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


@query(f"""WITH {BM25}, t AS (SELECT query_id, doc_id, rank FROM bmtop WHERE rank <= 5)
SELECT query_id, string_agg('[' || rank || '] Document ' || doc_id || ' - ' || source || ':' || chr(10) || left(text, 500), chr(10) || chr(10) ORDER BY rank) AS context FROM t JOIN documents USING (doc_id) GROUP BY query_id""")
def context_build(spark, sf_dir):
    top = settled(documents_index(spark, sf_dir).search(questions(spark, sf_dir), 5)).join(docs(spark, sf_dir), "doc_id")
    return context(top, 500, "\n\n")


def context(top: DataFrame, chars: int, between: str) -> DataFrame:
    """query_id and context: numbered blocks in the order of rank; a query has a handful of rows."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Document "), "doc_id", F.lit(" - "), "source", F.lit(":\n"), F.substring("text", 1, chars))
    blocks = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return blocks.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), between).alias("context"))


@query(f"""WITH {BM25} SELECT query_id, doc_id, rank, left(text, 300) AS excerpt FROM (SELECT b.query_id, b.doc_id, CAST(row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank) AS INT) AS rank, d.text FROM bmtop b JOIN q USING (query_id) JOIN documents d USING (doc_id)
 WHERE b.rank <= 20 AND 10 * {RELEVANCE} >= 2.0) WHERE rank <= 5""")
def context_topn(spark, sf_dir):
    """The first five relevant results of each query, 300 characters of each."""
    q = questions(spark, sf_dir)
    top = settled(documents_index(spark, sf_dir).search(q, 20).join(q, "query_id")).join(corpus(spark, sf_dir), "doc_id")
    top = top.filter(10 * fusion.lexical_relevance(F.col("query"), F.col("text")) >= 2.0)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("rank <= 5")
    return top.select("query_id", "doc_id", "rank", F.substring("text", 1, 300).alias("excerpt"))


PROMPT_SQL = "replace(replace('" + TEMPLATES["citation"].replace("\n", "' || chr(10) || '") + "', '{question}', query), '{context}', context)"


@query(f"""WITH {BM25}, t AS (SELECT query_id, doc_id, rank FROM bmtop WHERE rank <= 3),
c AS (SELECT query_id, string_agg('[' || rank || '] Document ' || doc_id || ' - ' || source || ':' || chr(10) || left(text, 300), chr(10) || chr(10) ORDER BY rank) AS context FROM t JOIN documents USING (doc_id) GROUP BY query_id)
SELECT query_id, {PROMPT_SQL} AS prompt FROM c JOIN q USING (query_id)""")
def prompt_build(spark, sf_dir):
    q = questions(spark, sf_dir)
    top = settled(documents_index(spark, sf_dir).search(q, 3)).join(docs(spark, sf_dir), "doc_id")
    return context(top, 300, "\n\n").join(q, "query_id").select("query_id", prompt("citation", F.col("query"), F.col("context")).alias("prompt"))


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _prompt_sql(name: str, context_: str) -> str:
    before, after = TEMPLATES[name].replace("{examples}", "").split("{context}")
    between, end = after.split("{question}")
    return f"SELECT query_id, '{name}' AS template, {_quoted(before)} || {context_} || {_quoted(between)} || query || {_quoted(end)} AS prompt FROM s JOIN q USING (query_id)"


#: The first three results of each query as sources, and the three layouts of them.
SOURCES = f"""{BM25}, t AS (SELECT query_id, rank, 'Document ' || doc_id AS title, source, left(text, 300) AS text FROM bmtop JOIN documents USING (doc_id) WHERE rank <= 3),
s AS (SELECT query_id, string_agg('[Source ' || rank || '] ' || title || ' (Page ' || rank || '):' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS attributed,
 string_agg('[' || rank || '] ' || title || ' (Page ' || rank || ', Source: ' || source || '):' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS numbered,
 string_agg('Document: ' || title || chr(10) || 'Section: ' || source || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS chat FROM t GROUP BY query_id)"""


def sources(spark, sf_dir) -> DataFrame:
    """query_id and sources: title, source, section, page (the rank stands for one) and text of the first three results."""
    top = settled(documents_index(spark, sf_dir).search(questions(spark, sf_dir), 3)).join(docs(spark, sf_dir), "doc_id")
    one = F.struct("rank", F.concat(F.lit("Document "), "doc_id").alias("title"), "source", F.col("source").alias("section"), F.col("rank").cast("string").alias("page"), F.substring("text", 1, 300).alias("text"))
    return top.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("sources"))


LAYOUTS = {"cot": "chat", "extractive": "chat", "citation": "chat", "few_shot": "chat", "attributed": "attributed", "numbered": "numbered"}


@query(f"WITH {SOURCES} " + " UNION ALL ".join(_prompt_sql(name, layout) for name, layout in LAYOUTS.items()))
def prompt_variants(spark, sf_dir):
    """Every template with the layout of sources that it asks for."""
    made = {"chat": chat, "attributed": attributed, "numbered": numbered}
    rows = sources(spark, sf_dir).join(questions(spark, sf_dir), "query_id")
    each = F.array(*[F.struct(F.lit(name).alias("template"), prompt(name, F.col("query"), made[layout](F.col("sources"))).alias("prompt")) for name, layout in LAYOUTS.items()])
    return rows.select("query_id", F.explode(each).alias("x")).select("query_id", "x.template", "x.prompt")


@query(f"""WITH {SOURCES}, h AS (SELECT conv_id AS query_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id)
SELECT query_id, nullif(concat_ws(chr(10) || chr(10) || '=====' || chr(10) || chr(10), 'Previous Conversation:' || chr(10) || nullif(history, ''), 'Relevant Documents:' || chr(10) || nullif(chat, '')), '') AS context
FROM s FULL JOIN h USING (query_id)""")
def context_history(spark, sf_dir):
    """The context of a turn: what was said before in the conversation of that number, and the documents found."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    history = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(said.alias("h"))
    history = history.select("query_id", F.array_join(F.transform("h", lambda x: x["line"]), "\n").alias("history"))
    found = sources(spark, sf_dir).select("query_id", chat(F.col("sources")).alias("chat"))
    return found.join(history, "query_id", "full_outer").select("query_id", with_history(F.col("history"), F.col("chat")).alias("context"))
