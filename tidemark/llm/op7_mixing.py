"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Targets: each source's share of the mix follows its weight, capped at ``max_repeats`` times the source's size with the
excess reshared. A block is one copy of a whole document with words. ``floor(target / size)`` copies of every document of a
source are taken, and one more of some: the first ones of a permutation that fit into what is left of the target, then, of
those still fitting, the largest (by powers of two) first, until none fits; one more is taken where that comes nearer. So a
source's words differ from its target by at most half of the least document that is left.

The blocks that a source gives are its quota. The tree halves the output shards again and again: at each node every
source's quota is split between the two halves by a multivariate-hypergeometric draw, so quotas stay exact and every half
gets its share of blocks. A leaf (shard) owns a range of each source's permuted blocks, disjoint from all others, and
shuffles them by a seed of its own: the mix holds of each source in each shard exactly the tree's quota. The documents of
the mix are dealt and sorted by shard and place.

Draws are by rejection under the log-concave bound of the probabilities, in a few steps at every size. The driver sees
one row per source (size, documents, what is left) and nothing else. Places in an order come from sums over equal slices of
the hash space, about one for every ``SLICE`` rows, so a source, or a shard, that holds most rows is spread over as many
tasks. Jobs run while the result is being built: the rows are counted and written first.

Null or empty text has size 0 and is never taken; null sources form one source, last in order; rows that are equal in
every respect are told apart by a running number (they share a task, as no hash can part them); an empty table gives an
empty result. Very long texts are counted whole. Columns beside doc_id, text, source and n_chars pass through, whatever
their names.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise, n_words, position, small_table, table

WEIGHTS = (5, 2, 1)
BITS, SLICE = 60, 4096


def water_fill(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: float = 2.0) -> list[float]:
    """Targets in the order of ``sizes``: proportional to weight, none above ``max_repeats`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [max_repeats * s for s in sizes]
    left, weight = share * sum(sizes), float(sum(w))
    targets = list(caps)
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / w[i])
    for at, i in enumerate(order):
        level = left / weight
        if caps[i] > level * w[i]:
            for j in order[at:]:
                targets[j] = level * w[j]
            break
        left -= caps[i]
        weight -= w[i]
    return targets


def log_rising(a: int, x: int) -> float:
    """ln(Gamma(a + x) / Gamma(a)), by differences of Stirling's series where the two logarithms would cancel."""
    if min(a, a + x) < 64:
        return math.lgamma(a + x) - math.lgamma(a)
    tail = lambda z: 1 / (12 * z) - 1 / (360 * z**3)
    return (a - 0.5) * math.log1p(x / a) + x * math.log(a + x) - x + tail(a + x) - tail(a)


def draw_hypergeometric(rng: random.Random, total: int, marked: int, drawn: int) -> int:
    """Marked ones among ``drawn`` of ``total``, without replacement.

    Rejection: the probabilities are log-concave, so with p that of the mode, at x from the mode they are at most
    p * min(1, exp(1 - p |x|)); a draw under that hat is accepted by the true ratio, in about five tries at every size.
    A smaller p makes the hat higher, so the least that the variance allows, (1 + 12 variance)^-1/2, serves as p.
    """
    low, high = max(0, drawn - (total - marked)), min(marked, drawn)
    if low == high:
        return low
    mode = min(max((drawn + 1) * (marked + 1) // (total + 2), low), high)
    rest = total - marked - drawn

    def log_ratio(x: int) -> float:
        """ln of the probability at mode + x against the mode's."""
        return -log_rising(mode + 1, x) - log_rising(marked - mode + 1, -x) - log_rising(drawn - mode + 1, -x) - log_rising(rest + mode + 1, x)

    mean = drawn * (marked / total)
    peak = (1 + 12 * mean * ((total - marked) / total) * ((total - drawn) / max(1, total - 1))) ** -0.5
    width = 1 + peak / 2
    while True:
        u, v = rng.random(), rng.random()
        if u <= width / (1 + width):
            y = rng.random() * width / peak
        else:
            y = (width - math.log(1 - rng.random())) / peak
        x = math.floor(y + 0.5) * (1 if rng.random() < 0.5 else -1)
        if low <= mode + x <= high and v * min(1.0, math.exp(width - peak * y)) <= math.exp(log_ratio(x)):
            return mode + x


def split_tree(quotas: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Quotas by shard and source: sums over shards give ``quotas``; shard totals differ by at most the depth's rounding."""
    if n_shards == 1:
        return [list(quotas)]
    halves = n_shards // 2
    room = sum(quotas) * halves // n_shards
    rng = random.Random(f"{seed}:{n_shards}:{sum(quotas)}")
    left, total, want = [], sum(quotas), room
    for q in quotas:
        got = draw_hypergeometric(rng, total, q, want)
        left.append(got)
        total -= q
        want -= got
    right = [q - x for q, x in zip(quotas, left)]
    return split_tree(left, halves, seed * 2 + 1) + split_tree(right, n_shards - halves, seed * 2 + 2)


def running(df: DataFrame, group: list[str], at: str, amount: str, out: str, ties: list[str], n_rows: int, classes: int = 0) -> DataFrame:
    """Sum of ``amount`` over the rows of the group before this one in the order of ``at``: slice sums first, then within a slice. ``classes``: leading bits of ``at`` that are no hash."""
    digits = max(0, -(-n_rows // SLICE) - 1).bit_length() + classes
    df = df.withColumn("_slice", F.shiftright(F.col(at), BITS - digits))
    sums = df.groupBy(*group, "_slice").agg(F.sum(amount).alias("_sum"))
    before = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_slice").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(before, [*group, "_slice"]).withColumn(out, F.col(out) + F.col("_base")).drop("_slice", "_base")


ROW = ["row_id", "doc_id", "r1", "r2", "dup", "sid", "size"]
TIES = ["doc_id", "r1", "r2", "dup"]


def by_source(spark: SparkSession, values: dict[int, int], name: str) -> DataFrame:
    """A number for each source, as a small table."""
    schema = T.StructType([T.StructField("sid", T.IntegerType()), T.StructField(name, T.LongType())])
    return F.broadcast(small_table(spark, sorted(values.items()), schema))


def last_copies(rows: DataFrame, left: dict[int, int], n_rows: int, seed: int) -> tuple[list[DataFrame], dict[int, int]]:
    """(tables of the rows that are taken once more, how many of each source), by passes over what still fits. ``left``: words for each source."""
    spark = rows.sparkSession
    taken: list[DataFrame] = []
    n_taken: dict[int, int] = {}
    pool = materialise(rows.where("size > 0").join(by_source(spark, {s: x for s, x in left.items() if x > 0}, "left"), "sid").withColumn("hash", position(f"last{seed}", F.col("doc_id"), F.col("dup"))).drop("left"), "mix-pool")
    size_class, first = F.lit(63) - F.floor(F.log2(F.col("size").cast("double"))).cast("long"), True

    def take(found: DataFrame) -> None:
        taken.append(found.select(*ROW))
        for r in found.groupBy("sid").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect():  # a row for each source
            left[r["sid"]] -= r["words"]
            n_taken[r["sid"]] = n_taken.get(r["sid"], 0) + r["n"]

    fitting = pool
    while True:
        room = by_source(spark, {s: x for s, x in left.items() if x > 0}, "left")
        fitting = fitting.join(room, "sid").where(F.col("size") <= F.col("left"))
        order = F.col("hash") if first else F.shiftleft(size_class, BITS - 6) + F.shiftright("hash", 6)
        tried = materialise(running(fitting.withColumn("at", order), ["sid"], "at", "size", "before", TIES, n_rows, 0 if first else 6).select(*ROW, "hash", (F.col("before") + F.col("size") <= F.col("left")).alias("fits")), "mix-tried")
        found, first = tried.where("fits"), False
        fitting = tried.where("not fits").drop("fits")
        if not found.limit(1).count():
            break
        take(found)
    nearer = pool.join(by_source(spark, {s: x for s, x in left.items() if x > 0}, "left"), "sid").where((F.col("size") > F.col("left")) & (F.col("size") < 2 * F.col("left")))
    if taken:
        used = taken[0].select("row_id")
        for t in taken[1:]:
            used = used.unionByName(t.select("row_id"))
        nearer = nearer.join(used, "row_id", "left_anti")
    least = nearer.groupBy("sid").agg(F.min(F.struct("size", "hash", *[c for c in ROW if c not in ("sid", "size")])).alias("e"))
    take(materialise(least.select("sid", "e.*").select(*ROW), "mix-nearer"))
    return taken, n_taken


def mix(docs: DataFrame, seed: int = 42, n_shards: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks). rows: row_id, doc_id, r1, r2, dup, size, source_size, target. blocks: row_id, r1, r2, dup, sid, copy, words, shard, place."""
    spark = docs.sparkSession
    source = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = docs.select("doc_id", source.alias("src"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("r1"), F.xxhash64(F.lit(3), "doc_id", "source", "text").alias("r2"))
    rows = rows.withColumn("dup", F.row_number().over(Window.partitionBy("r1", "r2").orderBy("size")))
    rows = materialise(rows.withColumn("row_id", F.monotonically_increasing_id()), "mix-rows")
    per = rows.groupBy("src").agg(F.sum("size").alias("words"), F.count(F.when(F.col("size") > 0, 1)).alias("docs")).orderBy("src.none", "src.name").collect()
    targets = water_fill([r["words"] for r in per])
    goals = [int(t + 0.5) for t in targets]
    whole = [g // r["words"] if r["words"] else 0 for g, r in zip(goals, per)]
    whole_number, text, fraction = T.LongType(), T.StringType(), T.DoubleType()
    schema = T.StructType([T.StructField(n, k) for n, k in (("sid", T.IntegerType()), ("none", T.BooleanType()), ("name", text), ("source_size", whole_number), ("target", fraction), ("whole", T.IntegerType()))])
    sources = small_table(spark, [(i, r["src"]["none"], r["src"]["name"], r["words"], t, w) for i, (r, t, w) in enumerate(zip(per, targets, whole))], schema).select("sid", F.struct("none", "name").alias("src"), "source_size", "target", "whole")
    known = rows.join(sources, "src").drop("src")
    n_rows = sum(r["docs"] for r in per)
    more, n_more = last_copies(known.select(*ROW), {i: g - w * r["words"] for i, (g, w, r) in enumerate(zip(goals, whole, per))}, n_rows, seed)
    quotas = [w * r["docs"] + n_more.get(i, 0) for i, (w, r) in enumerate(zip(whole, per))]
    ends: list[list[int]] = [[] for _ in quotas]
    for shard in split_tree(quotas, n_shards, seed):
        for s, q in enumerate(shard):
            ends[s].append((ends[s][-1] if ends[s] else 0) + q)
    bounds = small_table(spark, list(enumerate(ends)), T.StructType([T.StructField("sid", T.IntegerType()), T.StructField("ends", T.ArrayType(whole_number))]))
    blocks = known.where("size > 0 and whole > 0").select(*ROW, F.explode(F.sequence(F.lit(1), "whole")).alias("copy"))
    for found in more:
        blocks = blocks.unionByName(found.select(*ROW, F.lit(0).alias("copy")))
    n_blocks, ties = sum(quotas), [*TIES, "copy"]
    blocks = blocks.withColumn("at", position(f"block{seed}", F.col("doc_id"), F.col("dup"), F.col("copy"))).withColumn("one", F.lit(1))
    drawn = running(blocks, ["sid"], "at", "one", "rank", ties, n_blocks).join(F.broadcast(bounds), "sid")  # a row for each source
    drawn = drawn.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    drawn = drawn.withColumn("read", position(f"shard{seed}", F.col("shard"), F.col("doc_id"), F.col("dup"), F.col("copy")))
    placed = running(drawn.drop("at", "rank", "ends"), ["shard"], "read", "one", "place", ties, n_blocks)
    blocks = materialise(placed.select("row_id", "r1", "r2", "dup", "sid", "copy", F.col("size").alias("words"), "shard", "place"), "mix-blocks")
    return known.select("row_id", "doc_id", "r1", "r2", "dup", "size", "source_size", "target"), blocks


def mixed_documents(docs: DataFrame, seed: int = 42, n_shards: int = 16) -> DataFrame:
    """The mix as whole documents, one row for each block, dealt and sorted by shard and place."""
    rows, blocks = mix(docs, seed, n_shards)
    key = ["__tm_r1", "__tm_r2"]
    tagged = docs.withColumns({"__tm_r1": F.xxhash64("doc_id", "source", "text"), "__tm_r2": F.xxhash64(F.lit(3), "doc_id", "source", "text")})
    drawn = blocks.select(*[F.col(c).alias(f"__tm_{c}") for c in ("r1", "r2", "dup", "shard", "place")])
    # Rows that are equal in every respect need their running number; all others are found by their hashes, so texts are dealt once.
    equal = materialise(rows.where("dup = 2").select(F.col("r1").alias("__tm_r1"), F.col("r2").alias("__tm_r2")), "mix-equal")
    out = tagged.join(drawn.join(equal, key, "left_anti").drop("__tm_dup"), key)
    if equal.limit(1).count():
        numbered = tagged.join(equal, key, "left_semi").withColumn("__tm_dup", F.row_number().over(Window.partitionBy(*key).orderBy(*key)))
        out = out.unionByName(numbered.join(drawn, [*key, "__tm_dup"]).drop("__tm_dup"))
    out = out.repartitionByRange("__tm_shard", "__tm_place").sortWithinPartitions("__tm_shard", "__tm_place")
    return out.select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the columns asked for: the document's blocks in the mix, the first and last shard that holds one, and its place in the first."""
    rows, blocks = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = blocks.groupBy("row_id").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_blocks"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"), F.min(F.struct("shard", "place"))["place"].alias("first_place"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", none("taken"), none("n_blocks"), "first_shard", "last_shard", "first_place")
