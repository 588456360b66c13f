"""Hard negatives by dual-tree search over anchors and candidates.

Both sides are trees. The top of the candidates' tree splits space into cells by hyperplanes fitted on at most ``SAMPLE``
rows (a bounded sample: it only decides which rows lie together); a cell's rows, salted into pieces of about ``BLOCK_ROWS``
where it has more, are one block with its own tree of balls, stored ready for use. Anchors are packed and stored alike.
For a pair of nodes with centres a, c and radii r, s every inner product lies within |a| s + |c| r + r s of <a, c>. That
interval is held against what the anchors of the node still need - the lowest score that could enter any of their results,
the highest that their windows allow - and prunes the pair for the whole anchor group: first pairs of pack and block, in the
join that forms them, then pairs of inner nodes. Pairs of leaves are scored exactly.

Two searches: an anchor's positives are its first rows of the same label; then each of its positives sets a window of
scores, and the first rows of another label inside it are the negatives. Every anchor meets every block that its intervals
leave (a stated query set against all rows, in blocks); blocks and packs meet on a grid of tasks, so that no task holds
more than one pack and one block at a time, and a label or cell that has most rows is as many blocks as it needs. An anchor
keeps the best so far across all blocks that it meets in a task.

Scores are exact: vectors whose integers fit a double's 53 bits in any product are scored by matrix products, all others
("wide") apart by Python integers, without pruning; only a returned score beyond 64 bits is an error.

Special rows: rows with a null id, label or vector, or a null or non-finite component take no part. Empty vectors take
part: all their scores are 0. A vector meets only vectors of its own length. Repeated rows are rows of their own, as
candidates and as anchors; an anchor's positives are never rows of its own id. Ties go to the smaller id. A positive
with a negative score has an empty window, one with score 0 a window of 0 alone. An empty table gives an empty result. Only
the three named columns are read, whatever others are called.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import integers as I  # noqa: E741
from tidemark.llm.common import arrow_batches, materialise, table

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
BLOCK_ROWS, PACK_ROWS, SAMPLE, LEAF, ANCHOR_LEAF = 4096, 512, 8192, 256, 32
#: Labels are dealt into so many groups.
GROUPS = 64
#: Scores of vectors that are not wide stay below this.
EXACT = 2.0**53
NO_ID = np.iinfo(np.int64).max


def far_direction(x: np.ndarray) -> np.ndarray:
    """From a row far from the mean to the row farthest from that one."""
    gap = lambda p: ((x - p) ** 2).sum(axis=1)
    a = x[gap(x.mean(axis=0)).argmax()]
    return x[gap(a).argmax()] - a


class Balls:
    """A tree of balls over the rows of ``x``: ``order`` puts each node's rows from ``start`` to ``end``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int) -> None:
        self.order = np.lexsort((ids,))
        nodes: list[list] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = self.order[lo:hi]
            center = x[rows].mean(axis=0).astype(np.float32).astype(float)
            radius = float(np.sqrt(((x[rows] - center) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-9
            at = len(nodes)
            nodes.append([lo, hi, -1, -1, center, radius])
            if parent >= 0:
                nodes[parent][2 + side] = at
            if hi - lo > leaf:
                along = x[rows] @ far_direction(x[rows])
                if along.max() > along.min():
                    half = (hi - lo) // 2
                    split = np.argsort(along, kind="stable")
                    self.order[lo:hi] = np.concatenate([rows[np.sort(split[:half])], rows[np.sort(split[half:])]])
                    todo += [(lo, lo + half, at, 0), (lo + half, hi, at, 1)]
        self.shape = np.array([n[:4] for n in nodes], np.int32)
        self.centers, self.radii = np.stack([n[4] for n in nodes]), np.array([n[5] for n in nodes])


def numbers(data: bytes, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(shape) if data else np.zeros(shape, kind)


class Side:
    """A stored pack or block, with its tree."""

    def __init__(self, r: dict) -> None:
        self.wide, n, dims = r["wide"], len(r["ids"]) // 8, r["dims"]
        self.n, self.ids, self.labels = n, numbers(r["ids"], "<i8", n), numbers(r["labels"], "<i8", n)
        if self.wide:
            self.values = I.wholes(numbers(r["vectors"], "<f8", n, dims), SCALE)
        else:
            self.x = numbers(r["vectors"], "<i4", n, dims).astype(float)
            self.shape = numbers(r["shape"], "<i4", len(r["radii"]) // 8, 4)
            self.radii = numbers(r["radii"], "<f8", len(self.shape))
            self.centers = numbers(r["centers"], "<f4", len(self.shape), dims).astype(float)
            self.norms = np.linalg.norm(self.centers, axis=1)

    def exact(self) -> list[list[int]]:
        return self.values if self.wide else [[int(v) for v in row] for row in self.x.tolist()]


def block_of(leaf: int) -> Callable:
    """A group of rows as one record."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        dims, wide = int(part["dims"].iloc[0]), bool(part["wide"].iloc[0])
        x, ids = np.stack(part["x"].to_numpy()).astype(float).reshape(len(part), dims), part["id"].to_numpy(np.int64)
        out = {"dims": dims, "wide": wide, "grp": int(part["grp"].iloc[0]), "center": [[0.0] * dims], "radius": 0.0, "shape": b"", "centers": b"", "radii": b""}
        order = np.lexsort((ids,))
        if wide:
            vectors = x[order].astype("<f8")
        else:
            whole = np.floor(x * SCALE)
            tree = Balls(whole, ids, leaf)
            order, vectors = tree.order, whole[tree.order].astype("<i4")
            out |= {"center": [tree.centers[0].tolist()], "radius": tree.radii[0], "shape": tree.shape.astype("<i4").tobytes(), "centers": tree.centers.astype("<f4").tobytes(), "radii": tree.radii.astype("<f8").tobytes()}
        out |= {"ids": ids[order].tobytes(), "labels": part["label"].to_numpy(np.int64)[order].tobytes(), "vectors": vectors.tobytes()}
        if "rid" in part:
            windows = [None if w is None else json.loads(w) for w in part["windows"].to_numpy()[order]]
            edges = [e for w in windows for e in (w or [[None, None]])]
            bound = lambda v, none: none if v is None else float(max(-EXACT, min(EXACT, v)))
            out |= {"rids": part["rid"].to_numpy(np.int64)[order].tobytes(), "windows": json.dumps(windows), "lowest": min(bound(a, -np.inf) for a, _ in edges), "highest": max(bound(b, np.inf) for _, b in edges)}
        return pd.DataFrame({k: v if isinstance(v, list) else [v] for k, v in out.items()})

    return run


BLOCK = "dims int, wide boolean, grp int, center array<double>, radius double, shape binary, centers binary, radii binary, ids binary, labels binary, vectors binary"
PACK = f"{BLOCK}, rids binary, windows string, lowest double, highest double"


class Pack(Side):
    """Anchors with what each of them has found, for each of its windows."""

    def __init__(self, r: dict, k: int) -> None:
        super().__init__(r)
        self.rids = numbers(r["rids"], "<i8", self.n)
        self.windows = [w if w is not None else [[None, None]] for w in json.loads(r["windows"])]
        m = max(map(len, self.windows))
        self.low, self.high = np.full((self.n, m), np.inf), np.full((self.n, m), -np.inf)  # windows that do not exist are empty
        for i, w in enumerate(self.windows):
            for j, (a, b) in enumerate(w):
                self.low[i, j] = -np.inf if a is None else max(-EXACT, min(EXACT, a))
                self.high[i, j] = np.inf if b is None else max(-EXACT, min(EXACT, b))
        self.need = self.low.copy()
        self.scores, self.found = np.full((self.n, m, k), -np.inf), np.full((self.n, m, k), NO_ID)
        self.k, self.apart = k, []

    def meet(self, block: Side, same: bool) -> None:
        if self.wide or block.wide:
            return self.meet_exactly(block, same)
        todo = [(0, 0)]
        while todo:
            a, c = todo.pop()
            (lo, hi, left, right), (c_lo, c_hi, c_left, c_right) = self.shape[a], block.shape[c]
            middle = float(self.centers[a] @ block.centers[c])
            reach = (self.norms[a] * block.radii[c] + block.norms[c] * self.radii[a] + self.radii[a] * block.radii[c]) * (1 + 1e-9) + 1e-6
            if middle + reach < self.need[lo:hi].min() or middle - reach > self.high[lo:hi].max():
                continue
            if left < 0 and c_left < 0:
                self.score(int(lo), int(hi), block, int(c_lo), int(c_hi), same)
            elif c_left < 0 or left >= 0 and self.radii[a] > block.radii[c]:
                todo += [(left, c), (right, c)]
            else:
                near = [float(self.centers[a] @ block.centers[x]) for x in (c_left, c_right)]
                todo += [(a, c_left), (a, c_right)] if near[1] > near[0] else [(a, c_right), (a, c_left)]  # the better one is next

    def score(self, lo: int, hi: int, block: Side, c_lo: int, c_hi: int, same: bool) -> None:
        scores = self.x[lo:hi] @ block.x[c_lo:c_hi].T
        ids, equal = block.ids[c_lo:c_hi], self.labels[lo:hi, None] == block.labels[None, c_lo:c_hi]
        allowed = equal & (self.ids[lo:hi, None] != ids[None, :]) if same else ~equal
        scores = np.where(allowed, scores, -np.inf)
        for j in range(self.low.shape[1]):
            inside = (scores >= self.need[lo:hi, j, None]) & (scores <= self.high[lo:hi, j, None]) & allowed
            rows = np.flatnonzero(inside.any(axis=1))
            if len(rows):
                mine = np.where(inside[rows], scores[rows], -np.inf)
                first = np.argsort(-mine, axis=1, kind="stable")[:, : self.k]  # a leaf's rows are in order of id
                s, i = np.take_along_axis(mine, first, 1), ids[first]
                i = np.where(s == -np.inf, NO_ID, i)
                s, i = np.concatenate([self.scores[lo + rows, j], s], 1), np.concatenate([self.found[lo + rows, j], i], 1)
                best = np.lexsort((i, -s), axis=-1)[:, : self.k]
                self.scores[lo + rows, j], self.found[lo + rows, j] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
                self.need[lo + rows, j] = np.maximum(self.low[lo + rows, j], self.scores[lo + rows, j, -1])

    def meet_exactly(self, block: Side, same: bool) -> None:
        mine, theirs = self.exact(), block.exact()
        for i, (own, x) in enumerate(zip(self.ids, mine)):
            rows = [c for c in range(block.n) if (block.labels[c] == self.labels[i]) == same and not (same and block.ids[c] == own)]
            scored = sorted((-I.dot(x, theirs[c]), int(block.ids[c])) for c in rows)
            for j, (a, b) in enumerate(self.windows[i]):
                inside = [(-s, c) for s, c in scored if (a is None or -s >= a) and (b is None or -s <= b)]
                self.apart += [(int(self.rids[i]), j, c, *I.stored(s)) for s, c in inside[: self.k]]

    def results(self) -> pa.RecordBatch:
        i, j, k = np.nonzero(self.scores > -np.inf)
        columns = [self.rids[i], j, self.found[i, j, k], np.zeros(len(i), np.int64), self.scores[i, j, k].astype(np.int64), [""] * len(i)]
        columns = [[*(c.tolist() if isinstance(c, np.ndarray) else c), *(r[n] for r in self.apart)] for n, c in enumerate(columns)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["rid", "j", "vec_id", "over", "score", "digits"])


def search(k: int, same: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pack = None, None
        for batch in batches:
            for n in range(len(batch)):
                r = batch.slice(n, 1).to_pylist()[0]
                if held != r["pack"]["rids"]:
                    if pack is not None:
                        yield pack.results()
                    held, pack = r["pack"]["rids"], Pack(r["pack"], k)
                pack.meet(Side(r["block"]), same)
        if pack is not None:
            yield pack.results()

    return run


def meet(packs: DataFrame, blocks: DataFrame, keys: list[str], k: int, same: bool, window: Column | None) -> DataFrame:
    """rid, j, vec_id and score: the best ``k`` rows of each anchor and window. Packs and blocks are written tables with ``number``."""
    context = packs.sparkSession.sparkContext
    n_blocks, tasks = max(1, blocks.count()), 4 * context.defaultParallelism
    deals = min(n_blocks, max(1, round((50 * tasks) ** 0.5)))  # packs are a fiftieth of the rows: so the least is sent
    stripes = max(1, -(-tasks // deals))
    a = packs.select(*keys, F.pmod("number", F.lit(stripes)).alias("stripe"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"), F.struct(*packs.columns).alias("pack"))
    b = blocks.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("stripe"), F.pmod("number", F.lit(deals)).alias("deal"), F.struct(*blocks.columns).alias("block"))
    met = a.join(b.hint("merge"), [*keys, "stripe", "deal"])
    if window is not None:
        met = met.where(window)
    return met.select("pack", "block").mapInArrow(search(k, same), f"rid long, j int, vec_id long, {I.SCORE}")


def can_hold() -> Column:
    """Whether the interval of a pack and a block meets any of the pack's windows."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    a, c = F.col("pack"), F.col("block")
    middle = F.aggregate(F.zip_with(a["center"], c["center"], lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    reach = (norm(a["center"]) * c["radius"] + norm(c["center"]) * a["radius"] + a["radius"] * c["radius"]) * (1 + 1e-9) + 1e-6
    return a["wide"] | c["wide"] | ((middle + reach >= a["lowest"]) & (middle - reach <= a["highest"]))


def planes(x: np.ndarray, cells: int) -> list[tuple[int, np.ndarray, float, int, int]]:
    """Hyperplanes that split the sample into at most ``cells`` parts, the largest first: (cell, direction, cut) sends a cell's rows above the cut to a new cell."""
    parts, out = {0: x}, []
    while len(parts) < cells:
        cell = max(parts, key=lambda c: len(parts[c]))
        part = parts[cell]
        direction = far_direction(part)
        along = part @ direction
        cut = float(np.median(along))
        above = along > cut
        if len(part) < 16 or not above.any() or above.all():
            break
        out.append((cell, direction, cut, len(parts)))
        parts[cell], parts[len(parts)] = part[~above], part[above]
    return out


def with_cells(rows: DataFrame, block_rows: int) -> DataFrame:
    """Adds ``cell``: the leaf of the top tree that a row lies in."""
    groups = rows.where(~F.col("wide")).groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("grp").alias("g")).orderBy(F.col("n").desc()).limit(16).collect()  # other lengths have one cell
    trees = {}
    for r in groups:
        cells = -(-r["n"] // (block_rows * max(1, min(GROUPS, r["g"]))))
        if cells > 1 and r["dims"]:
            drawn = rows.where((F.col("dims") == r["dims"]) & ~F.col("wide")).orderBy(F.xxhash64("rid"), "rid").select("x").limit(SAMPLE).collect()
            trees[r["dims"]] = planes(np.array([d["x"] for d in drawn]), cells)
    if not trees:
        return rows.withColumn("cell", F.lit(0))

    @F.pandas_udf("int")
    def cell(x: pd.Series, wide: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int32)
        sizes = x.map(len).to_numpy()
        for dims, tree in trees.items():
            mine = np.flatnonzero((sizes == dims) & ~wide.to_numpy(bool))
            if len(mine):
                v, at = np.stack(x.iloc[mine].to_numpy()), np.zeros(len(mine), np.int32)
                for source, direction, cut, target in tree:
                    here = np.flatnonzero(at == source)
                    at[here[v[here] @ direction > cut]] = target
                out[mine] = at
        return pd.Series(out)

    return rows.withColumn("cell", cell("x", "wide"))


def stored(rows: DataFrame, keys: list[str], most: int, leaf: int, shape: str, name: str) -> DataFrame:
    """Rows with equal keys, in salted pieces of about ``most``, as records with a tree each; written, numbered."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("__pieces"))
    salted = rows.join(sizes, keys).withColumn("__piece", F.pmod(F.xxhash64("salt"), F.col("__pieces")))
    made = salted.groupBy(*keys, "__piece").applyInPandas(block_of(leaf), shape)
    return materialise(made.withColumn("number", F.pmod(F.xxhash64("ids", "vectors"), F.lit(1 << 40))), name)


def participants(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """id, label, x, dims, wide of the rows that take part."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull() & fine)
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(embedding, lambda x: x.cast("double")).alias("x")).withColumn("dims", F.size("x"))
    return rows.withColumn("wide", F.exists("x", lambda x: F.abs(x) * SCALE >= F.sqrt(F.lit(EXACT / 2) / F.greatest(F.col("dims"), F.lit(1)))))


def hard_negatives(vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, pack_rows: int = PACK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``low``, ``high``: percent of the positive's score."""
    arrow_batches(vectors.sparkSession)
    rows = participants(vectors).withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")).withColumn("rid", F.monotonically_increasing_id())
    rows = materialise(with_cells(materialise(rows, "negatives-input"), block_rows), "negatives-rows").withColumn("salt", F.col("rid"))
    blocks = stored(rows.drop("rid"), ["dims", "wide", "grp", "cell"], block_rows, LEAF, BLOCK, "negatives-blocks")
    anchors = rows.where(is_anchor(F.col("id")))
    packs = stored(anchors.withColumn("windows", F.lit(None).cast("string")), ["dims", "wide", "grp", "cell"], pack_rows, ANCHOR_LEAF, PACK, "negatives-anchors")
    first = Window.partitionBy("rid").orderBy(*I.best_first(), "vec_id")
    chosen = meet(packs, blocks, ["dims", "grp"], positives, True, None).withColumn("j", F.row_number().over(first) - 1).where(F.col("j") < positives)
    chosen = materialise(chosen.withColumnRenamed("vec_id", "positive_id"), "negatives-positives")

    @F.pandas_udf("string")
    def windows(found: pd.Series) -> pd.Series:
        """Windows of an anchor's positives, best first, as JSON with exact integers."""
        scores = [[I.loaded(p["over"], p["score"], p["digits"]) for p in sorted(ps, key=lambda p: p["j"])] for ps in found]
        return pd.Series([json.dumps([[-(-low * s // 100), high * s // 100] for s in ps]) for ps in scores])

    asked = chosen.groupBy("rid").agg(F.collect_list(F.struct("j", "over", "score", "digits")).alias("found"))  # at most ``positives`` each
    asked = anchors.join(asked.select("rid", windows("found").alias("windows")), "rid")
    packs = stored(asked.withColumn("grp", F.lit(-1)), ["dims", "wide", "cell"], pack_rows, ANCHOR_LEAF, PACK, "negatives-asked")
    found = meet(packs, blocks, ["dims"], negatives, False, can_hold())
    order = Window.partitionBy("rid", "j").orderBy(*I.best_first(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    found = found.select("rid", "j", "rank", F.col("vec_id").alias("negative_id"), I.within_64_bits().alias("negative_score"))
    known = chosen.select("rid", "j", "positive_id", "over", "score").join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    return found.join(known, ["rid", "j"]).select("anchor_id", "positive_id", "rank", "negative_id", I.within_64_bits().alias("positive_score"), "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's input: some rows get the next label, as the contract states."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", label.alias("label"), "embedding")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), lambda i: i % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
r AS (SELECT *, row_number() OVER () AS rid FROM v),
s AS (SELECT a.rid, a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM r a JOIN r c ON len(a.v) = len(c.v) AND (a.label <> c.label OR a.vec_id <> c.vec_id) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS j FROM s WHERE same) WHERE j <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.rid, p.j ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
