"""Sources: text, JSON lines, HTML folders, blocks of parsed PDF pages, JDBC and embedded vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import clean_text, trim_ws

#: File types that an upload may have.
UPLOADS = ("html", "htm", "pdf", "txt", "json", "jsonl")


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, title and cleaned content of each plain-text file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("title"), "value")
    return files.select("path", "title", clean_text(F.col("value")).alias("content"))


def read_html(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """url and html of each HTML file of a folder, sorted by path; bytes that are no UTF-8 are replaced."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,htm}").option("recursiveFileLookup", recursive)
    return r.load(path).select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html")).distinct().orderBy("url")


def read_json_documents(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Entries with a text from JSON lines; a file without such a line is one JSON value (an object or an array of them).

    path, entry (from 0), title and content; entries shorter than ``least``
    characters go, a missing title is ``Section n``.
    """
    fields = "text string, filepath string"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.from_json(x, fields)), lambda x: x["text"].isNotNull())
    whole = F.filter(F.coalesce(F.from_json("value", f"array<struct<{fields.replace(' string', ':string')}>>"), F.array(F.from_json("value", fields))), lambda x: x["text"].isNotNull())
    entries = files.select("path", F.when(F.size(lines) > 0, lines).otherwise(whole).alias("e")).select("path", F.posexplode("e").alias("entry", "e"))
    kept = entries.filter(F.length(trim_ws(F.col("e.text"))) >= least)
    base = F.element_at(F.split("e.filepath", "/"), -1)
    return kept.select("path", "entry", F.coalesce(base, F.concat(F.lit("Section "), F.col("entry") + 1)).alias("title"), clean_text(F.col("e.text")).alias("content"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ranges of its key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def decode_vectors(df: DataFrame, column: str) -> DataFrame:
    """A vector kept as JSON text becomes an array; what is none becomes null."""
    return df.withColumn(column, F.from_json(column, "array<double>"))


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url rows that no rule (host, prefix) forbids."""
    from quarry.functions.html import host

    u = urls.withColumn("host", host(F.col("url"))).withColumn("path", F.regexp_replace("url", r"^[^:]*://[^/]*", ""))
    return u.join(rules.select("host", "prefix"), (u["host"] == rules["host"]) & F.expr("startswith(path, prefix)"), "left_anti").select("url")


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Results of the first search, of the second for queries where the first has none."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def ingest_folder(spark: SparkSession, path: str) -> DataFrame:
    """The sections of all HTML files of a folder as one document: url, position (by path, then section), title, content and word_count."""
    return _sections(read_html(spark, path, recursive=True))


def ingest_home(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """(sections, files) of a home page: its own sections as those of ``ingest_folder``, and the relative HTML files that it links to, each once."""
    page = spark.read.format("binaryFile").load(home).select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))
    href = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)))
    links = page.select(href.alias("h")).select(F.regexp_replace("h", r"[?#].*$", "").alias("file"))
    files = links.filter(~F.col("file").startswith("http") & F.lower("file").rlike(r"\.html?$")).distinct().orderBy("file")
    return _sections(page), files


def _sections(pages: DataFrame) -> DataFrame:
    from quarry.functions.html import html_sections

    p = pages.withColumn("page_id", F.xxhash64("url"))
    found = html_sections(p.select("page_id", "url", "html")).join(p.select("page_id", "url"), "page_id")
    return found.select("url", F.col("section_id").alias("position"), "page_title", "title", "content", "word_count").orderBy("url", "position")
