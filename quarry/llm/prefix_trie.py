"""The trie of conversation prefixes, rolled up by centroid decomposition.

Conversations are sequences of turns; conversations that begin alike share the
nodes of their common prefix.  Turns are put in order by ranges of
(conversation, turn), so a conversation of any length is spread over tasks, and
texts stay where they are: what moves is a turn's hash and its number of words.
A prefix is named by the exclusive or of 128-bit hashes of its turns with their
places, a running sum that is taken range by range.

A node belongs to its smallest member.  The nodes of one owner are a piece of
one path, so the parent edges between nodes become a forest with a vertex for
each owner, however long its conversation is.  The weight of a vertex, the
conversations of its subtree, is the number of members of the path's top.

The forest is rolled up by centroids.  In each component the centroid is the
deepest vertex that has half of the weight; the vertices with as much are just
its way to the top.  The component's totals below the centroid are added to the
centroid and along that way, the centroid leaves, and the component falls into
its children's parts and the rest above, each of at most half the weight.
Components of more than ``WHOLE`` conversations are split by Spark, all at once,
and smaller ones within tasks.  Totals within a path are then running sums.

Rows without a conv_id belong to no conversation.  Turns of equal number are
ordered by the hash of role and text; null turns come first; null roles and
texts are empty.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work

#: Conversations of a component that a task takes whole.
WHOLE = 2048
#: Members that end at one node and are gathered there; more of them are hashed from a sorted stream.
GATHERED = 4096
#: Nodes of a path that are summed in one group.
STRETCH = 4096
WORD = r"[^\x20\x09-\x0D]+"
VALUES = ("saved", "leaves")
NODE = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, t1, t2, words and o, the turn's number from 1, with ``before`` (turns in earlier parts) within it; a part is a range of rows in one task."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", name.alias("t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t")]
    rows = rows.repartitionByRange(work.parts(spark), *order).sortWithinPartitions(*order)
    return rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), F.xxhash64(F.lit(1), "t").alias("t1"), F.xxhash64(F.lit(2), "t").alias("t2"), "words")


def shared_openings(conv_id: Column) -> tuple[Column, Column]:
    """The conversation whose first turns open this one, and how many of them: the contract's rule."""
    return conv_id - conv_id % 20, (F.crc32(conv_id.cast("string")) % 4).cast("long")


def rebuilt(turns: DataFrame, scratch: work.Scratch) -> DataFrame:
    """conv_id, part, depth, t1, t2, words and ``last`` for each turn of the rebuilt conversations, and a row of depth 0 for each."""
    base, h = shared_openings(F.col("conv_id"))
    counts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    of = Window.partitionBy("conv_id")
    parts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(of).alias("total"), F.min("part").over(of).alias("home"))
    parts = scratch.written(parts, "parts")
    convs = parts.filter("part = home").select("conv_id", "home", "total", base.alias("base"), h.alias("h"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    convs = convs.join(lengths, "base", "left").withColumn("m", F.least("h", F.coalesce("base_total", F.lit(0))))
    convs = scratch.written(convs.select("conv_id", "home", "base", "h", "m", (F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")), "convs")
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("seq"))
    numbered = turns.withColumn("nth", nth).join(parts.select("conv_id", "part", "before"), ["conv_id", "part"]).withColumn("o", F.col("nth") + F.col("before"))
    numbered = scratch.written(numbered.select("conv_id", "part", "o", "t1", "t2", "words"), "numbered")
    # parts of a conversation carry its numbers, so that no join has a whole conversation under one key
    own = numbered.join(parts.join(convs, "conv_id").select("conv_id", "part", "h", "m", "length"), ["conv_id", "part"]).filter("o > h").select("conv_id", "part", (F.col("m") + F.col("o") - F.col("h")).alias("depth"), "t1", "t2", "words", "length")
    heads = numbered.filter("conv_id % 20 = 0 and o <= 3").select(F.col("conv_id").alias("base"), F.col("o").alias("depth"), "t1", "t2", "words")
    opening = convs.join(heads, "base").filter("depth <= m").select("conv_id", F.col("home").alias("part"), "depth", "t1", "t2", "words", "length")
    root = convs.select("conv_id", F.col("home").alias("part"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("words"), "length")
    return own.unionByName(opening).unionByName(root).withColumn("last", F.col("depth") == F.col("length")).drop("length")


def named(turns: DataFrame, scratch: work.Scratch) -> DataFrame:
    """Adds the names of the prefix that ends with each turn (k1, k2) and of the one before (p1, p2)."""
    lane = lambda a, b, s: F.when(F.col("depth") > 0, F.xxhash64(a, b, "depth", F.lit(s))).otherwise(F.lit(0))
    turns = turns.withColumn("x1", lane("t1", "t2", 3)).withColumn("x2", lane("t2", "t1", 5)).drop("t1", "t2")
    turns = scratch.written(turns, "rebuilt")
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = turns.withColumn("k1", F.bit_xor("x1").over(so_far)).withColumn("k2", F.bit_xor("x2").over(so_far))
    # conversations that lie in several parts: what the earlier parts make
    totals = turns.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    several = totals.withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).filter("n > 1")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    several = several.select("conv_id", "part", *[F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(b) for b in ("b1", "b2")])
    out = out.join(several, ["conv_id", "part"], "left")
    for k in ("1", "2"):
        out = out.withColumn(f"k{k}", F.col(f"k{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))))
    return out.select("conv_id", "depth", "words", "last", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"))


def subtree_sums(parent: list[int], own: np.ndarray) -> np.ndarray:
    """Sums of ``own`` over the subtree of each vertex (parent: its index, -1 for a top), by centroid decomposition."""
    n, own = len(parent), own.tolist()
    children: list[list[int]] = [[] for _ in range(n)]
    for v, p in enumerate(parent):
        if p >= 0:
            children[p].append(v)
    width = len(own[0]) if n else 0
    out, gone = [[0] * width for _ in range(n)], bytearray(n)
    size, total = [0] * n, [None] * n
    tops = [v for v, p in enumerate(parent) if p < 0]
    while tops:
        top = tops.pop()
        component = [top]
        for v in component:
            component += [u for u in children[v] if not gone[u]]
        for v in reversed(component):
            below = [u for u in children[v] if not gone[u]]
            size[v] = 1 + sum(size[u] for u in below)
            total[v] = [sum(x) for x in zip(own[v], *(total[u] for u in below))]
        c = top
        while (heavy := next((u for u in children[c] if not gone[u] and 2 * size[u] >= size[top]), None)) is not None:
            c = heavy
        # the centroid's total goes to itself and along its way to the top
        v = c
        while True:
            out[v] = [a + b for a, b in zip(out[v], total[c], strict=True)]
            if v == top:
                break
            v = parent[v]
        gone[c] = 1
        tops += [u for u in children[c] if not gone[u]]
        if c != top:
            tops.append(top)
    return np.array(out, np.int64).reshape(n, width)


def _split(forest: DataFrame, scratch: work.Scratch) -> tuple[DataFrame, DataFrame] | None:
    """One round over the components of more than ``WHOLE`` weight: (forest, done), done with the totals of the centroids; None if there are no such components."""
    sums = lambda c: [F.sum(f"{c}{v}").alias(v) for v in VALUES]
    large = forest.filter((F.col("v") == F.col("comp")) & (F.col("w") > WHOLE)).select("comp", F.col("w").alias("whole"))
    large = scratch.written(large, "large")
    if large.isEmpty():
        return None
    there = forest.join(large, "comp")
    way = scratch.written(there.filter("2 * w >= whole").select("comp", "v", "w"), "way")
    # half of the weight lies below each of them, so they are one way down, and the lightest is its end
    centre = scratch.written(way.groupBy("comp").agg(F.min_by("v", F.struct("w", "v")).alias("c"), F.min("w").alias("cw")), "centroids")
    on_way = way.select(F.col("v").alias("on"))
    marked = there.join(centre, "comp").join(on_way.withColumnRenamed("on", "v").withColumn("mine", F.lit(True)), "v", "left").join(on_way.select(F.col("on").alias("up"), F.lit(True).alias("ups")), "up", "left")
    below = F.when(F.col("mine") | F.col("up").isNull(), F.col("comp")).when(F.col("up") == F.col("c"), F.col("v")).when(F.col("ups"), F.col("comp"))
    marked = scratch.written(marked.select("comp", "v", "up", "w", "c", "cw", F.coalesce("mine", F.lit(False)).alias("mine"), *VALUES, *[f"add_{v}" for v in VALUES], below.alias("label")), "marked")
    # which part each vertex falls into: the part of the vertex above it, by doubling steps
    labels = marked.select("v", "up", "label")
    while True:
        if labels.filter("label is null").isEmpty():
            break
        above = labels.select(F.col("v").alias("up"), F.col("up").alias("next"), F.col("label").alias("theirs"))
        known, open_ = labels.filter("label is not null"), labels.filter("label is null").join(above, "up")
        labels = scratch.written(known.unionByName(open_.select("v", F.col("next").alias("up"), F.col("theirs").alias("label"))), "labels")
    marked = marked.drop("label").join(labels.select("v", "label"), "v")
    totals = marked.filter((F.col("v") == F.col("c")) | (F.col("label") != F.col("comp"))).groupBy("comp").agg(*sums(""))
    totals = scratch.written(totals.select("comp", *[F.col(v).alias(f"c_{v}") for v in VALUES]), "totals")
    marked = scratch.written(marked.join(totals, "comp"), "marked")
    done = scratch.written(marked.filter("v = c").select("v", *[(F.col(f"c_{x}") + F.col(f"add_{x}")).alias(x) for x in VALUES]), "done")
    lighter = F.when(F.col("mine"), F.col("w") - F.col("cw")).otherwise(F.col("w"))
    more = [F.when(F.col("mine"), F.col(f"add_{x}") + F.col(f"c_{x}")).otherwise(F.col(f"add_{x}")).alias(f"add_{x}") for x in VALUES]
    rest = marked.filter("v <> c").select(F.col("label").alias("comp"), "v", F.when(F.col("label") != F.col("v"), F.col("up")).alias("up"), lighter.alias("w"), *VALUES, *more)
    out = scratch.written(rest.unionByName(forest.join(large, "comp", "left_anti").select(rest.columns)), "forest")
    return out, done


def _whole(forest: DataFrame, weight: int) -> DataFrame:
    """The totals of all vertices of components that fit a task."""

    def run(t: pa.Table) -> pa.Table:
        v, up = t.column("v").to_pylist(), t.column("up").to_pylist()
        index = {x: i for i, x in enumerate(v)}
        own, add = (np.stack([t.column(p + x).to_numpy() for x in VALUES], axis=1).astype(np.int64) for p in ("", "add_"))
        out = subtree_sums([-1 if x is None else index[x] for x in up], own) + add
        return pa.table({"v": pa.array(v, pa.int64()), **{x: pa.array(out[:, k], pa.int64()) for k, x in enumerate(VALUES)}})

    n = max(work.parts(forest.sparkSession), -(-weight // (16 * WHOLE)))
    dealt = forest.withColumn("bucket", F.pmod(F.xxhash64("comp"), F.lit(n)))
    return dealt.groupBy("bucket").applyInArrow(run, "v long, " + ", ".join(f"{x} long" for x in VALUES))


def rolled_up(forest: DataFrame, scratch: work.Scratch) -> DataFrame:
    """v and the sums of ``VALUES`` over its subtree.

    forest: v, up (the vertex above, null for a top), comp (the top of its
    tree), w (the weight of its subtree, in which each vertex has a part), and
    the values.
    """
    forest = scratch.written(forest.select("comp", "v", "up", "w", *VALUES, *[F.lit(0).cast("long").alias(f"add_{x}") for x in VALUES]), "forest")
    weight = forest.filter("v = comp").agg(F.sum("w")).head()[0] or 0
    finished = []
    while (after := _split(forest, scratch)) is not None:
        forest, done = after
        finished.append(done)
    out = _whole(forest, weight)
    for done in finished:
        out = out.unionByName(done)
    return scratch.written(out, "totals")


def ends(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256 of the nodes at which conversations end."""
    last = turns.filter("last").select(*NODE, "conv_id")
    crowded = nodes.filter(F.col("n_ends") > GATHERED).select(*NODE)
    few = last.join(crowded, NODE, "left_anti").groupBy(*NODE).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    few = few.select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def runs(batches):
        """Sorted rows as strings of ids, one for each node and batch."""
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in NODE], axis=1)
            ids = b.column("conv_id").to_numpy()
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, np.int64)
            joined = [",".join(map(str, x.tolist())) for x in np.split(ids, cut[1:])] if len(cut) else []
            yield pa.RecordBatch.from_arrays([*[pa.array(key[cut, k]) for k in range(3)], pa.array(ids[cut]), pa.array(joined, pa.string())], names=[*NODE, "conv_id", "ids"])

    def hashed(batches):
        """The hash of each node's strings, which come in order, one after the other."""
        node, digest = None, None
        for b in batches:
            for *key, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != node:
                    if node:
                        yield row(node, digest)
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if node:
            yield row(node, digest)

    def row(node, digest):
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([digest.hexdigest()], pa.string())], names=[*NODE, "ends_sha256"])

    parts = work.parts(turns.sparkSession)
    many = last.join(crowded, NODE, "left_semi").repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    many = many.mapInArrow(runs, "depth long, k1 long, k2 long, conv_id long, ids string")
    many = many.repartition(parts, *NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")
    return few.unionByName(many)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    scratch = work.Scratch(spark)
    turns = scratch.written(named(rebuilt(scratch.written(ordered_turns(conversations), "turns"), scratch), scratch), "named")
    nodes = turns.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.count_if("last").alias("n_ends"))
    nodes = scratch.written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    edges = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    parents = parents.withColumn("below", F.col("depth") > 0)
    full = nodes.join(edges, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    full = full.join(parents.drop("below"), ["depth", "p1", "p2"], "left")
    full = scratch.written(full.select("conv_id", "depth", "k1", "k2", "parent_conv_id", "n_convs", "n_children", *VALUES), "full")
    # a vertex for each owner: the top of its piece of path says what it hangs on
    paths = full.groupBy("conv_id").agg(F.min_by(F.struct("depth", "parent_conv_id", "n_convs"), "depth").alias("top"), *[F.sum(v).alias(v) for v in VALUES])
    paths = scratch.written(paths.select(F.col("conv_id").alias("v"), F.col("top.parent_conv_id").alias("up"), F.col("top.depth").alias("top"), F.col("top.n_convs").alias("w"), *VALUES), "paths")
    first = paths.filter("up is null").select(F.col("v").alias("comp"))  # all conversations meet in the root: one row
    sums = rolled_up(paths.join(F.broadcast(first)), scratch)
    hanging = sums.join(paths.select("v", "up", "top"), "v").filter("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(*[F.sum(v).alias(f"h_{v}") for v in VALUES])
    placed = full.join(hanging, ["conv_id", "depth"], "left").withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    placed = placed.select("conv_id", "depth", "stretch", "k1", "k2", "parent_conv_id", "n_convs", "n_children", *[(F.col(v) + F.coalesce(f"h_{v}", F.lit(0))).alias(v) for v in VALUES])
    placed = scratch.written(placed, "placed")
    up = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    # paths of several stretches: what the deeper ones hold
    long = placed.groupBy("conv_id", "stretch").agg(*[F.sum(v).alias(v) for v in VALUES]).withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).filter("n > 1")
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    long = long.select("conv_id", "stretch", *[F.coalesce(F.sum(v).over(deeper), F.lit(0)).alias(f"d_{v}") for v in VALUES])
    summed = placed.select("conv_id", "depth", "stretch", "k1", "k2", "parent_conv_id", "n_convs", "n_children", *[F.sum(v).over(up).alias(v) for v in VALUES]).join(long, ["conv_id", "stretch"], "left")
    out = summed.join(ends(turns, nodes), NODE, "left")
    whole = {v: (F.col(v) + F.coalesce(f"d_{v}", F.lit(0))).cast("long") for v in VALUES}
    nothing = hashlib.sha256(b"").hexdigest()
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", whole["leaves"].alias("n_leaves"), whole["saved"].alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    out = scratch.written(out, "trie")
    scratch.keep(out)
    return out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``."""
    work.small_batches(spark)
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
