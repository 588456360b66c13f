"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of the ring; a row's point is a hash of its doc_id, and the row belongs to the
next point clockwise. A shard takes rows up to its capacity; rows that find their shard full continue clockwise to
the next shard with room. Capacities sum to the number of rows (with ``slack=0`` they differ by at most one), so the
law that holds is ``rows``: counts at most one apart, whatever the keys. ``slack`` above 0 trades balance for movement.

Only the row count of each arc (n_shards * vnodes numbers, a fixed bound) reaches the driver, which walks the ring
once or twice and cuts arcs into segments; each row then finds its segment by arc and rank. Ranks are sums over slices
(``CELLS`` of the ring, each ``PARTS`` times by a hash of the whole row) and then within a slice, so neither many rows
in an arc nor a doc_id on a third of all rows ends in one task. Jobs run while the result is being built.

The law ``rows`` says nothing on rows of equal texts: they go where their doc_ids go. Rows with equal doc_id have one
point, so they fill neighbouring ranks of one arc and shards of one walk, as capacities allow. Null doc_ids hash as "~"
and are placed like others; rows equal in every column are interchangeable, and each has its own slot; null text has 0
bytes and crc32 0; an empty table gives an empty result; long texts count by their bytes alone.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import position, small_table, table

BITS = 60
CELLS = 4096  # equal slices of the ring, by which a row finds the few points near it
PARTS = 64


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) clockwise."""
    return sorted((int(hashlib.md5(f"vnode:{s}:{v}".encode()).hexdigest()[:15], 16), s) for s in range(n_shards) for v in range(vnodes))


def capacities(n_rows: int, n_shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [-int(-(n_rows * (1 + slack)) // n_shards)] * n_shards
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def walk(points: list[tuple[int, int]], counts: dict[int, int], caps: list[int]) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank, shard, first slot): each arc's own rows come first, then those carried on, in order."""
    free, slot = list(caps), [0] * len(caps)
    carried: deque[tuple[int, int, int]] = deque()
    out = []
    for lap in range(3):
        for arc, (_, shard) in enumerate(points):
            own = counts.get(arc, 0) if lap == 0 else 0
            if own:
                carried.appendleft((arc, 0, own))
            while carried and free[shard]:
                a, lo, hi = carried.popleft()
                n = min(hi - lo, free[shard])
                out.append((a, lo, shard, slot[shard]))
                free[shard] -= n
                slot[shard] += n
                if lo + n < hi:
                    carried.appendleft((a, lo + n, hi))
            if own and carried and carried[0][0] == arc:
                carried.rotate(-1)  # the arc's overflow waits behind what was carried here before
        if not carried:
            break
    return out


def with_arc(df: DataFrame, key: str, points: list[tuple[int, int]]) -> DataFrame:
    """Add ``_at`` (the row's point) and ``_arc`` (index of the next ring point clockwise)."""
    width = 1 << (BITS - CELLS.bit_length() + 1)
    cells: list[list[int]] = [[] for _ in range(CELLS)]
    for p, _ in points:
        cells[p // width].append(p)
    rows, before = [], 0
    for c, inside in enumerate(cells):
        rows.append((c, before, inside))
        before += len(inside)
    schema = T.StructType([T.StructField("__tm_cell", T.LongType()), T.StructField("__tm_before", T.LongType()), T.StructField("__tm_inside", T.ArrayType(T.LongType()))])
    lookup = small_table(df.sparkSession, rows, schema)  # CELLS rows, n_shards * vnodes points: a fixed bound
    df = df.withColumn("__tm_at", position("key", F.col(key))).withColumn("__tm_cell", F.shiftright("__tm_at", BITS - CELLS.bit_length() + 1))
    arc = (F.col("__tm_before") + F.size(F.filter("__tm_inside", lambda p: p < F.col("__tm_at")))) % F.lit(len(points))
    return df.join(F.broadcast(lookup), "__tm_cell").withColumn("__tm_arc", arc.cast("long")).drop("__tm_cell", "__tm_before", "__tm_inside")


def assign(docs: DataFrame, n_shards: int = 16, vnodes: int = 64, slack: float = 0.0, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; a table with columns of these names loses them first."""
    docs = docs.drop("shard", "slot")
    points = ring(n_shards, vnodes)
    counts = {r["__tm_arc"]: r["n"] for r in with_arc(docs.select(key), key, points).groupBy("__tm_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts: dict[int, list] = {}
    for arc, lo, shard, slot in walk(points, counts, capacities(sum(counts.values()), n_shards, slack)):
        cuts.setdefault(arc, []).append({"lo": lo, "shard": shard, "slot": slot})
    cut = T.StructType([T.StructField("lo", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    schema = T.StructType([T.StructField("__tm_arc", T.LongType()), T.StructField("__tm_segments", T.ArrayType(cut))])
    segments = small_table(docs.sparkSession, [(a, sorted(s, key=lambda x: x["lo"])) for a, s in cuts.items()], schema)
    others = [c for c in docs.columns if c != key]
    group = ["__tm_arc", "__tm_slice", "__tm_part"]
    sliced = with_arc(docs, key, points).withColumns({"__tm_slice": F.shiftright("__tm_at", BITS - CELLS.bit_length() + 1), "__tm_part": F.pmod(F.xxhash64(key, *others), F.lit(PARTS))})
    sums = sliced.groupBy(*group).agg(F.count(F.lit(1)).alias("__tm_sum"))
    earlier = Window.partitionBy("__tm_arc").orderBy("__tm_slice", "__tm_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, F.coalesce(F.sum("__tm_sum").over(earlier), F.lit(0)).alias("__tm_base"))
    inside = Window.partitionBy(*group).orderBy("__tm_at", key, *others)
    ranked = sliced.withColumn("__tm_rank", F.row_number().over(inside).cast("long") - 1).join(base, group).withColumn("__tm_rank", F.col("__tm_rank") + F.col("__tm_base"))
    placed = ranked.join(F.broadcast(segments), "__tm_arc")
    mine = F.element_at(F.filter("__tm_segments", lambda s: s["lo"] <= F.col("__tm_rank")), -1)
    return placed.withColumn("__tm_segments", mine).select(*docs.columns, F.col("__tm_segments.shard").alias("shard"), (F.col("__tm_segments.slot") + F.col("__tm_rank") - F.col("__tm_segments.lo")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return assign(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
