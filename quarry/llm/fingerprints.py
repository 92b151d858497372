"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is a sequence of words (each ideograph, kana or hangul syllable is a word
of its own).  A run of ``K`` words is an anchor when, of its inner runs of ``S``
words, one at either edge has the least hash; that depends on the run alone, not
on what stands around it, so equal passages have equal anchors wherever they
lie.  ``anchors`` gives them with their places for positional matching; a
fingerprint keeps the ``KEEP`` least anchor hashes, and the likeness of two
fingerprints estimates the Jaccard similarity of their anchor sets (exact where
both texts have fewer anchors than that).

A text of fewer than ``K`` words has one anchor, the hash of the whole text; an
empty or null text has none.  Two empty texts are alike (1), an empty and
another are not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work

K = 6
S = 2
KEEP = 64
#: White space between words, or the place after a character that stands alone.
CUT = r"[\x20\x09-\x0D]+|(?<=[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿])"


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of struct(pos, hash) of the anchors of a text column that is never null."""
    w, s = f"{out}_w", f"{out}_s"
    df = df.withColumn(w, F.array_remove(F.split(text, CUT), ""))
    df = df.withColumn(s, F.expr(f"if(size({w}) < {K}, array(), transform(sequence(0, size({w}) - {S}), i -> xxhash64(get({w}, i), get({w}, i + 1))))"))
    last = K - S
    inner = ", ".join(f"get({s}, i + {j})" for j in range(1, last))
    closed = f"filter(sequence(0, size({s}) - {last + 1}), i -> least(get({s}, i), get({s}, i + {last})) <= least({inner}))"
    covered = ", ".join(f"get({s}, i + {j})" for j in range(0, last + 1, S))
    whole = f"if(length({text}) = 0, array(), array(struct(0 as pos, hash({text}) as hash)))"
    return df.withColumn(out, F.expr(f"if(size({s}) = 0, {whole}, transform({closed}, i -> struct(i as pos, hash({covered}) as hash)))")).drop(w, s)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the least anchor hashes of a text column that is never null, ascending."""
    df = with_anchors(df, text, f"{out}_a")
    least = F.slice(F.sort_array(F.array_distinct(F.col(f"{out}_a.hash"))), 1, KEEP)
    return df.withColumn(out, least).drop(f"{out}_a")


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(F.expr("4294967295").bitwiseAND(x.cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of the least ``KEEP`` hashes of both together, the share that both have."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, KEEP)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, 1.0).otherwise(common / F.size(both))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, pos (word) and hash of every anchor of every document."""
    # outer: a filter on the array, which Spark infers otherwise, would make it anew for every entry
    each = with_anchors(work.texts(docs), "text", "a").select("doc_id", F.explode_outer("a").alias("a")).filter("a is not null")
    return each.select("doc_id", "a.pos", "a.hash")


def next_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (of one row of that id) and next_id: the following doc_id, after the last the first.

    Ids are dealt out by range; within a range the next id is a window's lead,
    and between ranges it is the first id of the next range, so that only one
    row a range is ever in one task.
    """
    spark = docs.sparkSession
    ids = work.texts(docs).select("doc_id", F.length("text").alias("n_chars"))
    ranged = ids.repartitionByRange(work.parts(spark), "doc_id").withColumn("part", F.spark_partition_id())
    ranged = work.written(ranged, "ids")
    one = ranged.groupBy("part", "doc_id").agg(F.max("n_chars").alias("n_chars"))
    firsts = one.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("follows"))
    lead = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return work.written(one.withColumn("lead", lead).join(firsts, "part").select("doc_id", "n_chars", F.coalesce("lead", "follows").alias("next_id")), "next-ids")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the last half gives way to the start of the next document.

    Rows that repeat a doc_id each keep their own text; what follows an id is
    the least text of the next id.
    """
    t = work.texts(docs)
    follows = next_ids(docs)
    one = t.groupBy("doc_id").agg(F.min("text").alias("text")) if follows.count() < t.count() else t
    need = follows.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    heads = with_fingerprint(one.join(need, "doc_id"), "text", "next_fp").select(F.col("before").alias("doc_id"), F.substring("text", F.lit(1), F.col("half")).alias("head"), "next_fp")
    rows = t.join(heads, "doc_id").withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("head", F.lit(1), half))).drop("head")
    rows = with_fingerprint(with_fingerprint(rows, "text", "fp"), "edited", "edited_fp")
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every document of ``documents`` and its edited text."""
    return fingerprint_edits(work.read_documents(spark, sf_dir))
