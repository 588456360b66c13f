"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers floor(scale * x). Rows are dealt into blocks; a block's index holds, for each
dimension, bitmaps of the binary digits of the shifted attribute (one bit of each row per bitmap), without the
``dropped`` lowest ones. A query's score is summed over the slices by bitmap arithmetic: every set bit of a query
coordinate adds that dimension's slices at its place, carries rippling upwards through the sum's own slices. Negative
coordinates are added by magnitude into a second sum, and one two's-complement subtraction ends it. The rows with the
highest sums are then selected from the most significant slice downward. The dropped digits leave each sum short of the
true score by a known most; rows within that of the boundary are resolved with the exact integers. Ties go to the smaller id.

Every query meets every block (a stated query set against all rows, in blocks); each pair of blocks returns k rows a
query, and the best k of those remain. Rows whose vector is null, or holds a null or a component that is not finite, or
whose id is null, take no part; a vector meets only vectors of its own length; empty vectors take part, with scores of 0. A
query's own row (same id) is no candidate. Repeated rows count as often as they occur, as candidates and as queries: every
query row asks for itself. An empty table gives an empty result. Columns beside vec_id and embedding are not read, whatever
their names. Jobs run while the result is being built (the index is written first).

Integers are exact at any size. Vectors with a scaled component of 2^62 or more (and empty ones) are kept apart from the
slices and scored by Python integers, as are the slices' rows against such queries; only a returned score beyond 64 bits is
an error, never a wrong row.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import integers as I  # noqa: E741
from tidemark.llm.common import arrow_batches, materialise, table

SCALE, K, DROPPED = 256, 5, 2
BLOCK_ROWS, QUERY_ROWS = 16384, 512


def pack(bits: np.ndarray) -> np.ndarray:
    """Booleans (..., rows), rows a multiple of 64, as uint64 words."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


class BitSlices:
    """The slices of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, dropped: int = DROPPED) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values, self.dropped = ids[order], values[order], dropped
        self.n, self.low = len(ids), values.min(axis=0)
        shifted = self.values.astype(np.uint64) - self.low.astype(np.uint64)  # wraps to the true difference, below 2^64
        self.reach = [max(abs(int(a)), abs(int(b))) for a, b in zip(self.low, self.values.max(axis=0))]
        self.digits = [max(0, int(m).bit_length() - dropped) for m in shifted.max(axis=0)]
        width = -(-self.n // 64) * 64
        padded = np.zeros((width, values.shape[1]), np.uint64)
        padded[: self.n] = shifted >> dropped
        self.slices = [[pack((padded[:, d] >> b) & 1 == 1) for b in range(self.digits[d])] for d in range(values.shape[1])]
        self.all = pack(np.arange(width) < self.n)

    def _add(self, total: list[np.ndarray], place: int, number: list[np.ndarray]) -> None:
        """total += number << place, slice by slice."""
        carry = None
        at = place
        for s in number:
            while len(total) <= at:
                total.append(np.zeros_like(self.all))
            t = total[at]
            x = t ^ s
            c = t & s
            if carry is not None:
                c |= x & carry
                x ^= carry
            total[at], carry = x, c
            at += 1
        while carry is not None and carry.any():
            if len(total) <= at:
                total.append(np.zeros_like(self.all))
            t = total[at]
            total[at], carry = t ^ carry, t & carry
            at += 1

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of sum(query * quantised attribute) + a constant that makes it non-negative in two's complement."""
        plus: list[np.ndarray] = []
        minus: list[np.ndarray] = []
        for d, q in enumerate(query.tolist()):
            side, m = (plus, q) if q > 0 else (minus, -q)
            place = 0
            while m:
                if m & 1:
                    self._add(side, place, self.slices[d])
                m >>= 1
                place += 1
        width = max(len(plus), len(minus)) + 1
        zero = np.zeros_like(self.all)
        plus += [zero] * (width - len(plus))
        minus += [zero] * (width - len(minus))
        out, borrow = [], zero
        for a, b in zip(plus, minus):
            x = a ^ b
            out.append(x ^ borrow)
            borrow = (~a & b) | (~x & borrow)
        out[-1] = ~out[-1]  # the sign, turned so that larger sums compare larger
        return out

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best."""
        if self.n <= k:
            return np.arange(self.n)
        total = self.sums(query)
        room = (1 << self.dropped) - 1
        numbers = query.tolist()
        most, least = room * sum(q for q in numbers if q > 0), room * sum(q for q in numbers if q < 0)
        edge, threshold, found = self.all.copy(), 0, 0
        for b in range(len(total) - 1, -1, -1):
            high = edge & total[b]
            n = int(np.bitwise_count(high).sum())
            if found + n >= k:
                edge = high
                threshold |= 1 << b
            else:
                found += n
                edge &= ~total[b]
        # ``threshold`` is the k-th highest quantised sum; the k-th true score is at least threshold * 2^dropped + least.
        quantised = threshold - (-(-(most - least) >> self.dropped))
        return np.flatnonzero(unpack(self.at_least(total, quantised), self.n))

    def at_least(self, total: list[np.ndarray], bound: int) -> np.ndarray:
        """Rows whose sum is at least ``bound``, compared from the most significant slice."""
        if bound <= 0:
            return self.all.copy()
        if bound >> len(total):
            return np.zeros_like(self.all)
        above, equal = np.zeros_like(self.all), self.all.copy()
        for b in range(len(total) - 1, -1, -1):
            if bound >> b & 1:
                equal &= total[b]
            else:
                above |= equal & total[b]
                equal &= ~total[b]
        return above | equal

    def top(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows other than ``own``, ties to the smaller id."""
        mine = int(np.searchsorted(self.ids, own, "right") - np.searchsorted(self.ids, own, "left"))
        rows = self.candidates(query, k + mine)
        rows = rows[self.ids[rows] != own]
        if sum(abs(q) * r for q, r in zip(query.tolist(), self.reach)) < 2**63:
            scores = self.values[rows] @ query
            best = np.lexsort((self.ids[rows], -scores))[:k]
            return list(zip(scores[best].tolist(), self.ids[rows][best].tolist()))
        return first(zip((self.values[rows].astype(object) @ query.astype(object)).tolist(), self.ids[rows].tolist()), k)


class Plain:
    """A block as lists of integers of any size."""

    def __init__(self, ids: np.ndarray, values: list[list[int]]) -> None:
        self.ids, self.values = ids.tolist(), values

    def top(self, own: int, query: list[int], k: int) -> list[tuple[int, int]]:
        return first(((I.dot(v, query), i) for v, i in zip(self.values, self.ids) if i != own), k)


def first(scored: Iterable[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return heapq.nsmallest(k, scored, key=lambda e: (-e[0], e[1]))


def narrow(vectors: np.ndarray) -> bytes:
    """Integers as bytes, four each where all of them fit, else eight."""
    fits = -(2**31) <= int(vectors.min()) and int(vectors.max()) < 2**31
    return vectors.astype("<i4" if fits else "<i8").tobytes()


def wide(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (rows * dims)}").astype(np.int64).reshape(rows, dims)


def block_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """One block's rows as one record: ids, row numbers and integers as bytes; the components themselves where a row is wide."""
    dims, apart, block = key
    vectors = np.concatenate([np.asarray(x, "<f8") for x in part["x"]]).tobytes() if apart else narrow(np.stack(part["v"].to_numpy()))
    return pd.DataFrame({"dims": [dims], "apart": [apart], "block": [block], "ids": [part["id"].to_numpy(np.int64).tobytes()], "rids": [part["rid"].to_numpy(np.int64).tobytes()], "vectors": [vectors]})


BLOCK = "dims int, apart boolean, block int, ids binary, rids binary, vectors binary"


def integers(data: bytes, rows: int, dims: int, apart: bool, scale: int) -> list[list[int]]:
    if not dims:
        return [[] for _ in range(rows)]
    return I.wholes(np.frombuffer(data, "<f8").reshape(rows, dims), scale) if apart else wide(data, rows, dims).tolist()


def search(k: int, dropped: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            for r in batch.to_pylist():
                by_slices = not r["apart"] and not r["query_apart"]
                ids, own, rids = (np.frombuffer(r[c], np.int64) for c in ("ids", "query_ids", "query_rids"))
                if held != (r["dims"], r["apart"], r["block"], by_slices):
                    held = r["dims"], r["apart"], r["block"], by_slices
                    index = BitSlices(ids, wide(r["vectors"], len(ids), r["dims"]), dropped) if by_slices else Plain(ids, integers(r["vectors"], len(ids), r["dims"], r["apart"], scale))
                queries = wide(r["queries"], len(own), r["dims"]) if by_slices else integers(r["queries"], len(own), r["dims"], r["query_apart"], scale)
                out = [(int(rid), int(q), i, *I.stored(s)) for rid, q, v in zip(rids, own, queries) for s, i in index.top(int(q), v, k)]
                kinds = zip(("rid", "query_id", "vec_id", "over", "score", "digits"), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))
                yield pa.record_batch({name: pa.array([o[n] for o in out], kind) for n, (name, kind) in enumerate(kinds)})

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, dims, apart, v array<bigint>, or x array<double> where apart) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.size("embedding").alias("dims"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = rows.withColumn("apart", (F.col("dims") == 0) | F.exists("x", lambda x: F.abs(x) * scale >= F.lit(2.0**62)))
    whole = F.transform("x", lambda x: F.floor(x * scale))
    return rows.select("id", "dims", "apart", F.when(~F.col("apart"), whole).alias("v"), F.when(F.col("apart"), F.col("x")).alias("x"))


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, dropped: int = DROPPED, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: a condition on ``id``; ranks are those of a query row."""
    arrow_batches(vectors.sparkSession)
    rows = materialise(quantised(vectors, scale).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    blocks = {(r["dims"], r["apart"]): max(1, -(-r["n"] // block_rows)) for r in rows.groupBy("dims", "apart").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not blocks:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for (d, a), n in table.items() for x in (f"{d} {str(a).lower()}", n)]), F.concat_ws(" ", F.col("dims").cast("string"), F.col("apart").cast("string")))
    index = rows.withColumn("block", F.pmod(F.xxhash64("rid"), of(blocks)).cast("int")).groupBy("dims", "apart", "block").applyInPandas(block_of, BLOCK)
    index = materialise(index.drop("rids"), "slices")
    pack_count = {d: 4 * max(1, -(-n * block_rows // (50 * query_rows))) for d, n in blocks.items()}
    packs = rows.where(is_query(F.col("id"))).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "rid"), of(pack_count)).cast("int")).groupBy("dims", "apart", "block").applyInPandas(block_of, BLOCK)
    packs = packs.select("dims", F.col("apart").alias("query_apart"), F.col("block").alias("pack"), F.col("ids").alias("query_ids"), F.col("rids").alias("query_rids"), F.col("vectors").alias("queries"))
    # While there are fewer blocks than cores, a block's rows go to several tasks, each with a part of the packs.
    deals = max(1, min(max(pack_count.values()), -(-4 * rows.sparkSession.sparkContext.defaultParallelism // sum(blocks.values()))))
    sides = F.array(F.lit(False), F.lit(True))
    pairs = packs.withColumn("apart", F.explode(sides)).withColumn("n", of(blocks)).where("n is not null")
    pairs = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("deal", F.col("pack") % deals).drop("n")
    dealt = index.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    pairs = pairs.join(dealt.hint("merge"), ["dims", "apart", "block", "deal"])
    found = pairs.select("dims", "apart", "block", "ids", "vectors", "query_apart", "query_ids", "query_rids", "queries").mapInArrow(search(k, dropped, scale), f"rid long, query_id long, vec_id long, {I.SCORE}")
    best = Window.partitionBy("rid").orderBy(*I.best_first(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", I.within_64_bits().alias("score"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""
