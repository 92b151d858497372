"""Connected components of a graph in a table, by alternating large and small stars.

Every round is aggregations over the edges and joins with what they give; the
edge table is written to the shared folder after each round, so lineage stays
short and a lost executor costs one round.  Only the last table stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (its component's least node) of every node of ``edges`` (a, b: long); self-edges count as nodes.

    A hub's neighbours are never gathered: a star needs only the least
    neighbour of a node, an aggregate, which meets the edges by a join.
    """
    scratch = work.Scratch(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = nodes = scratch.written(e, "edges")
    for _ in range(rounds):
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # large star: larger neighbours join the least of the neighbourhood
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).filter("v != u").distinct()
        # small star: the node and its smaller neighbours join the least of them
        low = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        small = large.withColumnRenamed("v", "x").join(low, "x")
        after = small.select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v != u").union(low.select(F.col("x").alias("v"), F.col("m").alias("u"))).distinct()
        after = scratch.written(after, "edges")
        # a forest of stars: each node has one edge, and no root has one
        done = after.groupBy("v").count().filter("count > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        scratch.keep(nodes, after)
        e = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    everyone = nodes.select(F.explode(F.array("v", "u")).alias("node")).distinct()
    out = scratch.written(everyone.join(e.withColumnRenamed("v", "node"), "node", "left").select("node", F.coalesce("u", "node").alias("root")), "roots")
    scratch.keep(out)
    return out
