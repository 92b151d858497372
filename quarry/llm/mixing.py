"""Mixing sources to target weights by exact block quotas.

Words are shared out among sources by weight, no source beyond ``MOST`` times
its size.  Documents fall by hash into blocks of their source, at most
``MOST_BLOCKS`` a source, so a hot source is spread over many groups; whole
blocks are taken in permuted order until the target is reached, and the last
document is cut to the words that are left.

Copies of blocks are dealt to output shards by a multivariate-hypergeometric
splitting tree: the quotas (blocks of each source) are split in two at random,
exactly, again and again until each shard has its own, and a source's permuted
blocks follow its shards' quotas, so that draws are disjoint.  A shard then
shuffles its rows locally.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work

#: Fixed values of the contract: weights by the order of sources, share of all words, most of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 50_000
MOST_BLOCKS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_key(source: Column) -> Column:
    """A key that is never null: null sources are one source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, src, and size: the words of the text (null: 0)."""
    return work.texts(docs, source_key(F.col("source").cast("string")).alias("src")).select("doc_id", "src", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """src, source_size and target (double): water-filling of ``share`` times all words.

    With sources by how soon they are full, the level at which the rest is
    shared rises while full ones go and falls after; the answer is its maximum.
    The windows hold one row a source.
    """
    per = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.when(F.col("src") == "n", 1).otherwise(0), "src")
    kth = F.array(*[F.lit(float(w)) for w in weights])[(F.row_number().over(order) - 1) % len(weights)]
    per = per.withColumn("weight", kth).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    soonest = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    everything = Window.partitionBy()
    full_before = F.coalesce(F.sum("cap").over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(soonest.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - full_before) / weight_left)
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("src", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """A row of quotas for each shard; rows differ by at most one in their sums and add up to ``quotas``."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    draw = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals") if total else quotas * 0
    return np.concatenate([split_quotas(draw, left, rng), split_quotas(quotas - draw, shards - left, rng)])


def mix(docs: DataFrame, seed: int = 1, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of ``docs``.

    taken: words that the mix takes, repeats counted; copies: whole copies, to
    which a cut one of ``taken - copies * size`` words is added.  Empty and null
    texts have size 0 and are never taken; repeated rows count each for itself.
    """
    sized = work.written(sizes(docs), "sizes")
    goal = targets(sized, share, weights, most)
    n_blocks = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS)))
    # the list of sources is small; doc rows meet it by a join that Spark may broadcast when it is
    of = sized.join(goal, "src").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n_blocks))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    by_block = of.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    permuted = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "src", "block"), "block")
    by_block = by_block.withColumn("whole", whole).withColumn("room", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long") - (F.sum("words").over(permuted) - F.col("words")))
    room = by_block.select("src", "block", "whole", F.greatest(F.lit(0), F.least("room", "words")).alias("room"), "words")
    rows = of.join(room, ["src", "block"])
    cut = (F.col("room") > 0) & (F.col("room") < F.col("words"))
    in_block = Window.partitionBy("src", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("size").over(in_block) - F.col("size")
    partly = rows.filter(cut).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - before)))
    wholly = rows.filter(~cut).withColumn("extra", F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0)))
    out = wholly.unionByName(partly)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("extra") == F.col("size"), 1).otherwise(0)).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), copies.cast("int").alias("copies"), "src", "block")


def shard_draws(mixed: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """src, block, draw, shard: where each copy of a block goes.

    One quota for each source comes to the driver; blocks stay in Spark.
    """
    blocks = mixed.groupBy("src", "block").agg(F.max(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("long").alias("draws"))
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "src", "block"), "block")
    blocks = blocks.withColumn("first", F.sum("draws").over(order) - F.col("draws")).filter("draws > 0")
    quotas = [(r["src"], int(r["n"])) for r in blocks.groupBy("src").agg(F.sum("draws").alias("n")).orderBy("src").collect()]
    spark = mixed.sparkSession
    table = split_quotas(np.array([n for _, n in quotas], np.int64), shards, np.random.default_rng(seed)) if quotas else np.zeros((shards, 0), np.int64)
    ends = spark.createDataFrame([(src, np.cumsum(table[:, k]).tolist()) for k, (src, _) in enumerate(quotas)], "src string, ends array<long>")
    each = blocks.select("src", "block", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("draw"), "first").join(ends, "src")
    at = F.col("first") + F.col("draw") - 1
    return each.select("src", "block", F.col("draw").cast("int").alias("draw"), F.size(F.filter("ends", lambda e: e <= at)).alias("shard"))


def _drawn(docs: DataFrame, mixed: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows drawn, with their shards, and ``mixed``; both with the keys of a row, of which ``nth`` tells repeated rows apart."""
    place = shard_draws(mixed, shards, seed)
    taken = mixed.filter("taken > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    keys = ["doc_id", "src", "size"]
    repeated = not mixed.groupBy(*keys).count().filter("count > 1").isEmpty()
    nth = Window.partitionBy(*keys)
    # repeated rows: the k-th row of an id meets the k-th decision
    taken = taken.withColumn("nth", F.dense_rank().over(nth.orderBy(F.desc("taken"))) if not repeated else F.row_number().over(Window.partitionBy(*keys, "draw").orderBy(F.desc("taken"))))
    decided = taken.join(place, ["src", "block", "draw"]).groupBy(*keys, "nth").agg(F.max("taken").alias("taken"), F.collect_list(F.struct("draw", "shard")).alias("draws"))
    rows = docs.select(
        F.struct(*[F.col(work.quoted(c)) for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source").cast("string")).alias("src"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    rows = rows.withColumn("nth", F.row_number().over(nth.orderBy(F.col("row.text"))) if repeated else F.lit(1))
    rows = rows.join(decided, [*keys, "nth"]).select("row", *keys, "nth", "taken", F.explode("draws").alias("to"))
    left = F.col("taken") - (F.col("to.draw") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), left.cast("int")), "")
    text = F.when(left < F.col("size"), cut).otherwise(F.col("row.text"))
    rows = rows.select(*keys, "nth", F.col("row").withField("text", text).alias("row"), F.col("to.shard").alias("shard"), F.xxhash64(F.lit(seed + 2), "row.doc_id", "to.draw").alias("place"))
    return rows, mixed.withColumn("nth", F.row_number().over(nth.orderBy(F.desc("taken"))) if repeated else F.lit(1))


def mix_documents(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """The mix itself: ``row`` (struct of all columns of ``docs``) as often as the mix takes it, and its ``shard``; shuffled within shards.

    A document that the mix takes in part has its last copy cut after the last
    word taken.  Decisions are joined while they are small; texts move once to
    their decisions and once to their shards.
    """
    rows, _ = _drawn(docs, work.written(mix(docs, seed), "mix"), shards, seed)
    return in_shards(rows, shards, work.buckets(docs)).select("row", "shard")


def in_shards(rows: DataFrame, shards: int, parts: int) -> DataFrame:
    """Rows dealt to their shards and shuffled there; a shard has its own partitions, ``parts`` or some more in all."""
    spread = -(-parts // shards)
    at = F.col("shard") * spread + F.pmod("place", F.lit(spread))
    return rows.repartitionById(shards * spread, at.cast("int")).sortWithinPartitions("shard", "place")


def mix_counts(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, and taken and copies as counted in the shards: one row for each row of ``docs``."""
    rows, mixed = _drawn(docs, work.written(mix(docs, seed), "mix"), shards, seed)
    keys = ["doc_id", "src", "size", "nth"]
    dealt = in_shards(rows, shards, work.buckets(docs)).withColumn("words", F.regexp_count("row.text", F.lit(WORD)).cast("long"))
    counted = dealt.groupBy(*keys).agg(F.sum("words").alias("taken"), F.sum((F.col("words") == F.col("size")).cast("int")).cast("int").alias("copies"))
    out = mixed.drop("taken", "copies").join(counted, keys, "left")
    return out.select("doc_id", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("taken", "long"), ("copies", "int"))))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all ``documents``: 150 % of all words, sources weighted 3, 1, 2 in turn."""
    return mix_counts(work.read_documents(spark, sf_dir))
