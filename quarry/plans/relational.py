"""Queries over the star schema: kinds of joins, windows and grouping sets that the engine offers for free."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.sources.tables import table

from .registry import query


@query("""SELECT c.c_custkey, n.n_name, count(o.o_orderkey) AS n_orders, round(coalesce(sum(o.o_totalprice), 0.0), 2) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL""")
def join_kinds(spark, sf_dir):
    """A dimension joined by broadcast when small, a fact by sort-merge; both chosen by Spark."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    out = c.join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("c_custkey", "n_name", F.coalesce("k", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def status_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INT) AS place, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INT) AS quarter, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_order FROM orders""")
def window_kinds(spark, sf_dir):
    by = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.dense_rank().over(by.orderBy(F.desc("o_totalprice"))).alias("place"), F.ntile(4).over(by.orderBy("o_totalprice", "o_orderkey")).alias("quarter"), F.lead("o_orderkey").over(by.orderBy("o_orderkey")).alias("next_order"))
