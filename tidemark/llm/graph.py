"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT, forget, materialise


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each edge (a, b) with the smallest vertex known of b in b's place.

    Edges run from the larger vertex to the smaller, so that is b's own least target, or b. Hubs, which more than one in
    ``HOT`` of all edges end at, are fewer than ``HOT`` and go by broadcast: their edges stay where they are.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
    hubs = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > total)
    hubs = hubs.join(low, "b", "left").select("b", F.coalesce("m", "b").alias("hub"))
    marked = edges.join(F.broadcast(hubs), "b", "left")
    rest = marked.where("hub is null").select("a", "b").join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    return marked.where("hub is not null").select("a", F.col("hub").alias("b")).unionByName(rest)


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every vertex ``a`` that is not the smallest of its component, with the smallest, ``b``."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialise(ends, "cc", compact=True)
    if now.isEmpty():
        return now
    mark = _mark(now)
    while True:
        nxt = materialise(_small_star(_large_star(now, mark[0])), "cc", compact=True)
        forget(now)
        now, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            return now
