"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import mixing, ngram_join, packing, passage_dedup, quality_rules, tokens, work


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars, where there is one, follows the text."""
    if "n_chars" in like.columns:
        df = df.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return df.select(*[F.col(work.quoted(c)) for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a null or empty text has too few words. Repeated rows are judged alike, an empty table stays empty."""
    work.small_batches(spark)
    return quality_rules.judge(docs, whole=True).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 on 5-word shingles, the one with the least doc_id stays; documents without words stay."""
    work.small_batches(spark)
    documents, _ = ngram_join.ngram_join(docs, 5, 80, every=False)
    kept = documents.filter("doc_id = component_id").select("doc_id").distinct()
    out = docs.join(kept.hint("merge"), docs["doc_id"].cast("long") == kept["doc_id"], "left_semi")
    if not documents.groupBy("doc_id").count().filter("count > 1").isEmpty():  # rows that repeat an id: the least text stays
        rows = out.select(F.struct(*[F.col(work.quoted(c)) for c in docs.columns]).alias("row"))
        out = rows.withColumn("nth", F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text"))).filter("nth = 1").select("row.*")
    return out


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has, exactly or nearly, are cut out; documents stay, be it with an empty text."""
    work.small_batches(spark)
    out = passage_dedup.repeated_passages(docs, whole=True)
    return _columns(out.select("doc_id", "text", *(["row.*"] if "row" in out.columns else [])), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (at most twice); texts without words are never taken. Repeated rows count each for itself, null sources are one source, an empty table stays empty."""
    work.small_batches(spark)
    return _columns(mixing.mix_documents(docs).select("row.*"), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens; an empty or null text is a piece of its end id. Ties in length go by rank, an empty table gives no rows."""
    work.small_batches(spark)
    return packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"), 1)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("mixing to target weights", mixture),
    ("packing", sequences),
]

#: Mixing draws by hash and packing tokenizes: SQL expresses neither; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of ``documents``."""
    docs = work.read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = work.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
