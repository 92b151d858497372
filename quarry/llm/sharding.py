"""Shards of near equal bytes by fixed virtual slots.

A record falls into one of ``SLOTS`` virtual slots by the md5 of its doc_id,
whatever the number of shards.  Bytes are summed per slot, and a map says which
shard holds which slot.  The first map deals the slots, largest first, to the
lightest shard.  Maps are stored by version; growing or rebalancing edits the
last one, so only as many slots move as it takes, and a reader of an older
version still finds its rows.

A slot that holds much of a shard's share (a doc_id that repeats without end)
is cut into pieces of a sixteenth of a share, by bytes in the order of its
rows, so no id can fill a shard.  Rows are numbered within groups of about
``GROUP_ROWS``: a slot of more rows is salted by input partition and the
groups' totals give the offsets.  What reaches the driver is a row for each
slot and piece: at most ``SLOTS`` and twenty for each shard.

A null text is empty (its size is ``ROW_BYTES``), a null doc_id is an id of its
own.  Repeated rows each have their place; ties in the order of rows are rows
that are alike.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work

#: Fixed number of virtual slots: three hexadecimal digits.
SLOTS = 4096
#: Bytes that a row counts besides its text.
ROW_BYTES = 8
#: Pieces of a shard's share that a large slot is cut into.
PIECES = 16
#: Rows of a slot that are numbered in one group.
GROUP_ROWS = 1 << 20
#: Part of a fair share by which the fullest shard may stand out before an edit moves slots.
SLACK = 0.01

Unit = tuple[int, int]


def slot_of(doc_id: Column) -> Column:
    """The virtual slot of an id: the first three hexadecimal digits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int")


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and origin (the input partition) of each row."""
    rows = work.texts(docs, *more)
    extra = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.select("doc_id", (F.octet_length("text").cast("long") + ROW_BYTES).alias("size"), F.crc32("text").alias("text_crc32"), slot_of(F.col("doc_id")).alias("virtual_slot"), F.spark_partition_id().alias("origin"), *extra)


@dataclass
class Plan:
    """How the rows of each slot are numbered and cut: groups, and bytes of a piece (0: the slot is whole)."""

    cuts: dict[int, tuple[int, int]]

    @classmethod
    def of(cls, rows: DataFrame, shards: int) -> Plan:
        per = rows.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()  # one row a slot
        total = sum(r["b"] for r in per)
        step = max(total // (shards * PIECES), 1)
        return cls({r["virtual_slot"]: (-(-r["n"] // GROUP_ROWS), step if 4 * shards * r["b"] > total else 0) for r in per})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, *x) for s, x in self.cuts.items()], "virtual_slot int, groups int, step long")


def numbered(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds nth (the row's number in its slot, from 0) and piece."""
    with_plan = rows.join(F.broadcast(plan.table(rows.sparkSession)), "virtual_slot").withColumn("group", F.pmod("origin", F.col("groups")))
    keys = ["virtual_slot", "group"]
    so_far = Window.partitionBy(*keys).orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = with_plan.withColumn("nth", F.count("*").over(so_far) - 1).withColumn("ahead", F.sum("size").over(so_far) - F.col("size"))
    if any(n > 1 for n, _ in plan.cuts.values()):
        totals = with_plan.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        earlier = Window.partitionBy("virtual_slot").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"))
        out = out.join(offsets, keys).withColumn("nth", F.col("nth") + F.col("n0")).withColumn("ahead", F.col("ahead") + F.col("b0")).drop("n0", "b0")
    piece = F.when(F.col("step") > 0, F.floor(F.col("ahead") / F.col("step"))).otherwise(0).cast("int")
    return out.withColumn("piece", piece).drop("origin", "groups", "step", "group", "ahead")


def dealt(units: dict[Unit, int], shards: int) -> dict[Unit, int]:
    """A first map: units, the largest first (ties: the lesser), each to the lightest shard (ties: the lesser)."""
    loads = [(0, k) for k in range(shards)]
    out = {}
    for u in sorted(units, key=lambda u: (-units[u], u)):
        load, k = heapq.heappop(loads)
        out[u] = k
        heapq.heappush(loads, (load + units[u], k))
    return out


def edited(old: dict[Unit, int], units: dict[Unit, int], shards: int, slack: float = SLACK) -> dict[Unit, int]:
    """The map ``old`` for these units and shards, with as few moves as it takes.

    Units that are new, or whose shard is gone, go to the lightest shard.  Then
    the fullest shard gives to the lightest one until no shard is above a fair
    share by more than ``slack`` of it, or no move brings them nearer.  Into a
    set of old shards that are even, one more shard only takes.
    """
    out = {u: old[u] for u in units if old.get(u, shards) < shards}
    loads, held = [0] * shards, [set() for _ in range(shards)]
    for u, k in out.items():
        loads[k] += units[u]
        held[k].add(u)

    def put(u: Unit, k: int) -> None:
        out[u] = k
        loads[k] += units[u]
        held[k].add(u)

    for u in sorted(set(units) - set(out), key=lambda u: (-units[u], u)):
        put(u, min(range(shards), key=lambda k: (loads[k], k)))
    most = (1 + slack) * sum(loads) / max(shards, 1)
    while shards > 1:
        full, light = max(range(shards), key=lambda k: (loads[k], -k)), min(range(shards), key=lambda k: (loads[k], k))
        gap = loads[full] - loads[light]
        # the unit that leaves the two nearest to each other
        u = min((u for u in held[full] if 0 < units[u] < gap), key=lambda u: (abs(gap - 2 * units[u]), u), default=None)
        if loads[full] <= most or u is None:
            return out
        held[full].remove(u)
        loads[full] -= units[u]
        put(u, light)
    return out


def write_map(spark: SparkSession, path: str, version: int, shards: int, plan: Plan, units: dict[Unit, tuple[int, int, int]], to: dict[Unit, int]) -> None:
    """Store a version: virtual_slot, piece, step (bytes of a piece), bytes, rows, shard, and base (rows of the shard before the unit)."""
    rows, base = [], [0] * shards
    for u in sorted(units):
        n, b, first = units[u]
        rows.append((*u, plan.cuts[u[0]][1], b, n, first, to[u], base[to[u]]))
        base[to[u]] += n
    kind = "virtual_slot int, piece int, step long, bytes long, rows long, first long, shard int, base long"
    spark.createDataFrame(rows, kind).withColumn("shards", F.lit(shards)).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the last one by default."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).head()[0]
    return every.filter(F.col("version") == F.lit(version))


def rebalanced(spark: SparkSession, path: str, shards: int, units: dict[Unit, tuple[int, int, int]] | None = None, plan: Plan | None = None) -> int:
    """Edit the last version for ``shards`` shards, or for the bytes of ``units`` now; the new version's number."""
    last = read_map(spark, path).collect()  # one row a unit
    old = {(r["virtual_slot"], r["piece"]): r["shard"] for r in last}
    units = units or {(r["virtual_slot"], r["piece"]): (r["rows"], r["bytes"], r["first"]) for r in last}
    plan = plan or Plan({r["virtual_slot"]: (1, r["step"]) for r in last})
    version = last[0]["version"] + 1 if last else 1
    write_map(spark, path, version, shards, plan, units, edited(old, {u: x[1] for u, x in units.items()}, shards))
    return version


def placed(rows: DataFrame, to: DataFrame) -> DataFrame:
    """Rows (numbered) with shard and slot, the row's place in its shard; the map is at most a few thousand rows."""
    found = rows.join(F.broadcast(to.select("virtual_slot", "piece", "first", "shard", "base")), ["virtual_slot", "piece"])
    return found.withColumn("slot", F.col("base") + F.col("nth") - F.col("first")).drop("first", "base", "nth")


def units_of(rows: DataFrame) -> dict[Unit, tuple[int, int, int]]:
    """Rows, bytes and first number of each slot and piece."""
    per = rows.groupBy("virtual_slot", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.min("nth").alias("first"))
    return {(r["virtual_slot"], r["piece"]): (r["n"], r["b"], r["first"]) for r in per.collect()}


def shard_rows(docs: DataFrame, shards: int = 24, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot, piece: a row for each row of ``docs``, by a map that is stored (at ``path``) as the next version."""
    spark = docs.sparkSession
    path = path or work.new_path(spark, "slot-map")
    rows = work.written(sized(docs), "sizes")
    plan = Plan.of(rows, shards)
    rows = work.written(numbered(rows, plan), "numbered")
    units = units_of(rows)
    try:
        version = rebalanced(spark, path, shards, units, plan)
    except Exception as e:  # no map there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        version = 1
        write_map(spark, path, version, shards, plan, units, dealt({u: x[1] for u, x in units.items()}, shards))
    return placed(rows, read_map(spark, path, version))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """All rows of ``docs``, whole, as Parquet in one folder for each shard (``shard=``, with underscores if ``docs`` has such a column), and the map beside them.

    A text moves once, to its shard; only rows of slots that are cut are
    numbered together with their texts.
    """
    spark = docs.sparkSession
    rows = work.written(sized(docs), "sizes")
    plan = Plan.of(rows, shards)
    units = units_of(numbered(rows, plan))
    write_map(spark, f"{path}/map", 1, shards, plan, units, dealt({u: x[1] for u, x in units.items()}, shards))
    to = read_map(spark, f"{path}/map", 1)
    cut = [s for s, (_, step) in plan.cuts.items() if step]
    whole = sized(docs, F.struct(*[F.col(work.quoted(c)) for c in docs.columns]).alias("row"))
    simple = whole.filter(~F.col("virtual_slot").isin(cut)).join(F.broadcast(to.filter("step = 0").select("virtual_slot", "shard")), "virtual_slot").select("row", "shard", "doc_id")
    pieces = placed(numbered(whole.filter(F.col("virtual_slot").isin(cut)), plan), to).select("row", "shard", "doc_id") if cut else simple.limit(0)
    spread = max(1, work.buckets(docs) // shards)
    out = simple.unionByName(pieces).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.crc32("row.text")), F.lit(spread)))
    name = "shard"
    while name in docs.columns:
        name += "_"
    out.repartition("shard", "salt").select(F.col("shard").alias(name), "row.*").write.partitionBy(name).mode("overwrite").parquet(f"{path}/rows")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 23 whose bytes are near equal."""
    out = shard_rows(work.read_documents(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "piece")
