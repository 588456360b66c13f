"""N-gram Jaccard join by chosen paths.

Texts become sets of five-word shingles (a text of one to four words has one shingle, all its words; no words, no set
and no links). Equal sets collapse into one representative with a weight. The join then goes

1. Chosen paths. Each set carries 128 min-hash tokens. A node of the tree samples ``branches`` of the 128 positions;
   every set in the node goes to one child for each sampled position, by the token it has there, so sets sharing a
   sampled token stay together. Nodes of one set vanish, nodes of up to ``small`` sets are brute-forced (nodes of the
   very same sets once), larger ones are split again with fresh positions. ``runs`` trees are grown, as many as the
   target recall for a pair at the threshold asks for (``runs_for``).
2. A large node first sheds its near-copies: every set is held against a dozen pivots, a random sample of the node.
   A set close to a pivot leaves the node; it and everything moderately close to a pivot are connected with it, and
   pivots that share a set with each other. By the triangle inequality of the Jaccard distance nothing similar to
   a set that left is farther from that set's pivot than this allows. A third of all rows in one node thus costs a
   dozen comparisons each. What is still large at the last level is compared in blocks.
3. Candidates are only ever stars (set, smallest set it may belong with), never all pairs of a group. Their connected
   components are compared exactly, from the texts, in one block each, or in pairs of blocks where a component is
   large; blocks return each set's number of links and, again, stars.

Result: one row per document: class_id (smallest doc_id of its connected group of links), rep_id (smallest doc_id with
the same set), n_links (other documents at or above the threshold, copies included). A null doc_id counts as the
largest; repeated rows are documents of their own; an empty table gives an empty result; very long texts are compared
whole. Jobs run while the result is being built: it is a series of written tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, materialise, table
from tidemark.llm.graph import components
from tidemark.llm.wordtable import Words, chunks, mix64

SHINGLE, THRESHOLD = 5, 0.8
TOKENS = 128
BRANCHES, LEVELS, SMALL = 3, 4, 256
BRANCHES_BELOW = 2  # a pair comes down by a dozen paths at once
RECALL = 0.999999
PIVOTS = 12
LEAVES = 0.7  # estimate at which a set leaves for its pivot
NOISE, SPREAD_NOISE = 0.22, 0.1  # room for the estimates' errors, largest at one half
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000
RUN_ROWS = 256  # rows that a kernel takes up at a time, beside those of the keys they share
LAST = 2**63 - 1
U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(7))
MULTIPLY = _RNG.integers(1, 2**32, TOKENS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 2**32, TOKENS, dtype=np.uint64).astype(np.uint32)


def runs_for(recall: float, threshold: float = THRESHOLD, branches: int = BRANCHES, levels: int = LEVELS) -> int:
    """Trees needed so that a pair at the threshold stays together in at least one with probability ``recall``."""
    lost = 1 - (1 - (1 - threshold) ** branches) ** levels
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def bounds_for(threshold: float) -> tuple[float, float, float]:
    """(likely, related, spread) for pairs at the threshold.

    likely: the estimate below which such a pair practically never falls, 7 standard deviations down. related, spread: how
    far from a leaving set's pivot its partner may be, and how much farther than from the partner's own best pivot, by
    the triangle inequality of the distance.
    """
    likely = threshold - 50**0.5 * (threshold * (1 - threshold) / TOKENS) ** 0.5
    return likely, LEAVES - (1 - threshold) - NOISE - 1e-9, 2 * (1 - threshold) + SPREAD_NOISE + 1e-9


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): each text's distinct shingle hashes, ascending."""
    at, grams = words.grams(k)
    owner = words.text[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.array([mix64(np.bitwise_xor.reduce(words.hash[words.first[d] : words.first[d + 1]] * (np.arange(1, words.counts[d] + 1, dtype=U) * U(2) + U(1)), keepdims=True) + U(words.counts[d]))[0] for d in short], U)
        grams, owner = np.concatenate([grams, extra]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[first], np.searchsorted(owner[first], np.arange(words.n + 1))


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)):
        sums = np.zeros(len(sets) + 1, U)
        np.cumsum(mix64(sets ^ salt), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Min-hash tokens (texts with a set, TOKENS), uint32."""
    has = np.diff(bounds) > 0
    out = np.zeros((len(has), TOKENS), np.uint32)
    if not len(sets):
        return out
    low, starts = (sets >> U(16)).astype(np.uint32), bounds[:-1][has]
    for t in range(TOKENS):
        v = low * MULTIPLY[t] + ADD[t]
        v ^= v >> np.uint32(15)
        out[has, t] = np.minimum.reduceat(v, starts)
    return out


def describe(k: int, runs: int, branches: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch):
                sets, bounds = shingle_sets(words, k)
                f1, f2 = fingerprints(sets, bounds)
                tokens32 = signatures(sets, bounds)
                roots = np.concatenate([kids(np.full(words.n, r + 1, U), tokens32, 0, branches) for r in range(runs)])
                sketch = tokens32.astype(np.uint8)
                paths = pa.ListArray.from_arrays(pa.array(np.arange(words.n + 1) * len(roots), pa.int32()), pa.array(roots.T.ravel().view(np.int64)))
                yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), pa.array(f1), pa.array(f2), pa.array(np.diff(bounds), pa.int64()), paths, pa.array([s.tobytes() for s in sketch], pa.binary())], ["doc", "r1", "r2", "f1", "f2", "size", "paths", "sketch"])

    return run


def kids(node: np.ndarray, sketch: np.ndarray, level: int, branches: int) -> np.ndarray:
    """(branches, rows): each row's children: positions sampled by the node, no position twice, and the token there (32 bits at the roots, 8 below)."""
    place = np.zeros((branches, len(node)), np.int64)
    out = np.zeros((branches, len(node)), U)
    for j in range(branches):
        at = (mix64(node + U((level * 64 + j + 1) * 0x9E3779B97F4A7C15 % 2**64)) % U(TOKENS)).astype(np.int64)
        for _ in range(j):
            at = np.where((place[:j] == at).any(axis=0), (at + 1) % TOKENS, at)
        place[j] = at
        token = sketch[np.arange(len(node)), at].astype(U) + U(1)
        out[j] = mix64(node * U(0xD1342543DE82EF95) + mix64(token * U(TOKENS) + at.astype(U) + U(1)))
    return out


def grow(level: int, branches: int) -> Callable:
    """Children of each (rid, node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, node = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(U)
            out = kids(node, tokens(batch.column(2)), level, branches)
            sketch = pa.concat_arrays([batch.column(2)] * branches)
            yield pa.record_batch([pa.array(np.tile(rid, branches)), pa.array(out.ravel().view(np.int64)), sketch], ["rid", "node", "sketch"])

    return run


def tokens(column: pa.Array) -> np.ndarray:
    """(rows, TOKENS) uint8 of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, TOKENS), np.uint8)
    _, offsets, data = column.buffers()
    lo = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[lo[0] : lo[-1]].reshape(len(column), -1)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of n through the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs_of(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Rows sorted by the key column, in tables that never cut a key."""
    held: list[pa.RecordBatch] = []
    for batch in (b.slice(lo, RUN_ROWS) for b in batches for lo in range(0, b.num_rows, RUN_ROWS)):
        keys = np.asarray(batch.column(key))
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if held and (cut or np.asarray(held[-1].column(key))[-1] != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def compare_small(likely: float) -> Callable:
    """(node, other, rid, sig) sorted by node: pairs inside a node, or between its rows with other = 0 and 1; stars of the likely ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches):
            node = np.asarray(part.column(0).combine_chunks())
            side = np.asarray(part.column(1).combine_chunks())
            rid = np.asarray(part.column(2).combine_chunks())
            sig = tokens(part.column(3))
            order = np.lexsort((rid, node))
            node, side, rid, sig = node[order], side[order], rid[order], sig[order]
            left, right = [], []
            for k in range(1, len(node)):
                i = np.flatnonzero(node[:-k] == node[k:])
                if not len(i):
                    break
                i = i[(side[i] == 2) | (side[i] != side[i + k])]
                for s in range(0, len(i), 1 << 15):
                    x = i[s : s + (1 << 15)]
                    x = x[(sig[x] == sig[x + k]).sum(axis=1) >= likely * TOKENS - 1e-9]
                    left.append(x)
                    right.append(x + k)
            if not left:
                continue
            label = stars(len(node), np.concatenate(left), np.concatenate(right))
            move = label != np.arange(len(node))
            yield pa.record_batch([pa.array(rid[move]), pa.array(rid[label[move]])], ["a", "b"])

    return run


def shed(related: float, spread: float) -> Callable:
    """(rid, node, sketch, pivots: array of (rid, sketch)) -> edges (a, b) without node and sketch, and rows that stay: (rid, 0, node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, node, own = np.asarray(batch.column(0)), np.asarray(batch.column(1)), tokens(batch.column(2))
            lists = batch.column(3)
            bounds, pivots = np.asarray(lists.offsets), lists.values
            pid, psk = np.asarray(pivots.field(0)), tokens(pivots.field(1))
            count = np.diff(bounds)
            row = np.repeat(np.arange(len(rid)), count)
            which = np.repeat(bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(len(row))
            same = (own[row] == psk[which]).mean(axis=1)
            most = np.maximum.reduceat(same, np.cumsum(count) - count) if len(row) else same
            linked = (same >= related) & (same >= most[row] - spread)
            row, which, same = row[linked], which[linked], same[linked]
            ids, at = np.unique(np.concatenate([rid[row], pid[which]]), return_inverse=True)
            label = stars(len(ids), at[: len(row)], at[len(row) :])
            move = label != np.arange(len(ids))
            pairs = np.stack([ids[move], ids[label[move]]])
            stay = most < LEAVES
            n, m = pairs.shape[1], int(stay.sum())
            kept = batch.column(2).filter(pa.array(stay))
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([pairs[0], rid[stay]])),
                    pa.array(np.concatenate([pairs[1], np.zeros(m, np.int64)])),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(node[stay])]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), kept]),
                ],
                ["a", "b", "node", "sketch"],
            )

    return run


def overlaps(sets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all intersections, from shared shingles alone."""
    out = np.zeros((n, n), np.float64)
    order = np.argsort(sets, kind="stable")
    s, o = sets[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    which = np.cumsum(new) - 1
    often = np.bincount(which) > 1
    o, which = o[often[which]], (np.cumsum(often) - 1)[which[often[which]]]
    step = max(64, (4 << 20) // max(1, n))
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(which, (lo, lo + step))
        x = np.zeros((n, min(step, int(often.sum()) - lo)), np.float32)
        x[o[a:b], which[a:b] - lo] = 1
        out += x @ x.T
    return out


def verify(k: int, threshold: float) -> Callable:
    """(group, side, rid, doc's f1, weight, text, cut) sorted by group -> (rid, links, root, cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches):
            batch = part.combine_chunks().to_batches()[0]
            group, side, rid, f1, weight = (np.asarray(batch.column(i)) for i in range(5))
            cut = np.asarray(batch.column(6))
            sets, lens, ok = [], [], []
            for rows, words in chunks(batch):
                s, b = shingle_sets(words, k)
                ok.append(fingerprints(s, b)[0])
                sets.append(s)
                lens.append(np.diff(b))
            everything, size = np.concatenate(sets), np.concatenate(lens)
            at = np.concatenate([[0], np.cumsum(size)])
            good = np.concatenate(ok) == f1
            edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if group[0] > -(2**63) else 0) != 0)
            edges[0] = 0
            for lo, hi in zip(edges, [*edges[1:], len(group)]):
                mine = lo + np.flatnonzero(good[lo:hi])
                mine = mine[np.unique(rid[mine], return_index=True)[1]]  # rows with equal id and set stand for one
                if len(mine) < 2:
                    continue
                n = size[mine]
                flat = np.concatenate([everything[at[m] : at[m + 1]] for m in mine])
                both = overlaps(flat, np.repeat(np.arange(len(mine)), n), len(mine))
                link = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
                np.fill_diagonal(link, False)
                if (side[mine] != 2).any():
                    link &= side[mine][:, None] != side[mine][None, :]
                i, j = np.nonzero(np.triu(link))
                label = stars(len(mine), i, j)
                yield pa.record_batch([pa.array(rid[mine]), pa.array(link.astype(np.int64) @ weight[mine]), pa.array(rid[mine[label]]), pa.array(np.full(len(mine), bool(cut[lo])))], ["rid", "links", "root", "cut"])

    return run


def candidate_stars(reps: DataFrame, below: int = BRANCHES_BELOW, levels: int = LEVELS, small: int = SMALL, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): sets that may be at or above the threshold, connected in stars."""
    likely, related, spread = bounds_for(threshold)
    found: list[DataFrame] = []
    children = reps.select("rid", F.explode("paths").alias("node"))
    for level in range(levels):
        mark = [F.bit_xor(F.xxhash64("rid")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(5), "rid")).alias("m2")]
        nodes = children.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("least"), *mark).where("n > 1")
        once = materialise(nodes.groupBy("n", "m1", "m2").agg(F.min("node").alias("node"), F.min("least").alias("least")), f"nodes{level}", compact=True)  # nodes of the same sets
        few, many = once.where(F.col("n") <= small), once.where(F.col("n") > small)
        if not level:  # only rows in nodes of two sets or more get a sketch; below, rows carry theirs
            shared = children.join(once, "node", "left_semi").join(reps.select("rid", "sketch"), "rid")
            children = materialise(shared.select("rid", "node", "sketch"), "held", compact=True)
        little = children.join(few, "node", "left_semi").select("node", F.lit(2).alias("side"), "rid", "sketch")
        found.append(little.repartition("node").sortWithinPartitions("node").mapInArrow(compare_small(likely), "a long, b long"))
        if many.isEmpty():
            break
        # Semi-joins filter rows and the draw is part of its join: a row of a large node meets its pivots once, and is in no other join's output.
        drawn = (F.col("rid") == F.col("least")) | (F.pmod(F.xxhash64(F.lit(9), "node", "rid"), F.greatest(F.lit(1), F.floor(F.col("n") / PIVOTS)).cast("long")) == 0)
        pivots = children.join(many.select("node", "n", "least"), "node").where(drawn).groupBy("node").agg(F.collect_list(F.struct("rid", "sketch")).alias("pivots"))
        split = children.join(pivots, "node").select("rid", "node", "sketch", "pivots")
        split = materialise(split.mapInArrow(shed(related, spread), "a long, b long, node long, sketch binary"), f"shed{level}", compact=True)
        found.append(split.where("sketch is null").select("a", "b"))
        rest = split.where("sketch is not null").select(F.col("a").alias("rid"), "node", "sketch")
        if level + 1 < levels:
            children = materialise(rest.mapInArrow(grow(level + 1, below), "rid long, node long, sketch binary"), f"paths{level + 1}", compact=True)
        else:
            found.append(in_blocks(rest, small, likely))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def block_pairs(df: DataFrame, node: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks that its own takes part in; side: 2 inside a block, else 0 or 1."""
    own = F.pmod(F.xxhash64(F.lit(11), "rid"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    pairs = df.withColumn("_own", own).withColumn("_other", other)
    key = F.xxhash64(node, F.least("_own", "_other"), F.greatest("_own", "_other"))
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    return pairs.withColumn("group", key).withColumn("side", side).drop("_own", "_other")


def in_blocks(rest: DataFrame, small: int, likely: float) -> DataFrame:
    """All pairs of what no split made small, block against block."""
    sizes = rest.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(small)).cast("long").alias("blocks"))
    pairs = block_pairs(rest.join(sizes, "node"), "node", "blocks").select("group", "side", "rid", "sketch")
    return pairs.repartition("group").sortWithinPartitions("group").mapInArrow(compare_small(likely), "a long, b long")


def classes(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc, r1, r2, class, rep, n_links, first (the one document of its class to keep)."""
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(3), "doc_id", "text").alias("r2"), "text")
    marks = materialise(docs.mapInArrow(describe(k, runs_for(recall, threshold), BRANCHES), "doc long, r1 long, r2 long, f1 long, f2 long, size long, paths array<long>, sketch binary").withColumn("rid", F.monotonically_increasing_id()), "sets")
    full = marks.where("size > 0")
    groups = full.groupBy("f1", "f2").agg(F.min(F.struct("doc", "rid")).alias("least"), F.count(F.lit(1)).alias("weight"))
    groups = materialise(groups.select("f1", "f2", F.col("least.doc").alias("rep"), F.col("least.rid").alias("rid"), "weight"), "groups", compact=True)
    reps = groups.select("rid", "weight").join(full.select("rid", "r1", "r2", "f1", "size", "paths", "sketch"), "rid")
    reps = materialise(reps, "reps", compact=True)
    stars_found = candidate_stars(reps, threshold=threshold)
    parts = materialise(components(stars_found), "parts", compact=True)
    members = parts.select(F.col("a").alias("rid"), F.col("b").alias("part")).unionByName(parts.select(F.col("b").alias("rid"), F.col("b").alias("part")).distinct())
    members = materialise(members.join(reps.select("rid", "r1", "r2", "f1", "size", "weight"), "rid"), "members", compact=True)
    sizes = members.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_SETS)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("long").alias("blocks"))
    placed = materialise(block_pairs(members.join(sizes, "part"), "part", "blocks").select("group", "side", "rid", "f1", "weight", "r1", "r2", (F.col("blocks") > 1).alias("cut")), "placed", compact=True)
    # Of rows equal in id and text (null ids are one id), one text goes on, however many there are.
    met = docs.join(members.select("r1", "r2").hint("merge"), ["r1", "r2"], "left_semi").select("r1", "r2", "text")
    texts = materialise(met, "met").groupBy("r1", "r2").agg(F.first("text").alias("text"))
    checked = placed.hint("merge").join(texts, ["r1", "r2"]).select("group", "side", "rid", "f1", "weight", "text", "cut")
    links = materialise(checked.repartition("group").sortWithinPartitions("group").mapInArrow(verify(k, threshold), "rid long, links long, root long, cut boolean"), "links", compact=True)
    whole = links.where("not cut").select("rid", "links", "root")  # compared in one block: the block's stars are final
    parted = links.where("cut")
    roots = components(parted.select(F.col("rid").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("rid"), F.col("b").alias("root"))
    summed = parted.groupBy("rid").agg(F.sum("links").alias("links")).join(roots, "rid", "left").select("rid", "links", F.coalesce("root", "rid").alias("root"))
    known = groups.select("f1", "f2", "rid", "rep", "weight").join(whole.unionByName(summed), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    known = materialise(known, "known", compact=True)
    least = known.groupBy("root").agg(F.min(F.struct("rep", "rid")).alias("head"))
    known = known.join(least, "root").select("f1", "f2", "rep", F.col("head.rep").alias("class"), F.col("head.rid").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    placed_docs = full.select("doc", "r1", "r2", "f1", "f2", "rid").join(known, ["f1", "f2"]).select("doc", "r1", "r2", "class", "rep", "n_links", (F.col("rid") == F.col("head")).alias("first"))
    alone = marks.where("size = 0").select("doc", "r1", "r2", F.col("doc").alias("class"), F.col("doc").alias("rep"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return placed_docs.unionByName(alone)


def without_near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each class; documents without words all stay."""
    kept = classes(docs, k, threshold, recall).where("first").select(F.col("r1").alias("__tm_r1"), F.col("r2").alias("__tm_r2")).groupBy("__tm_r1", "__tm_r2").agg(F.count(F.lit(1)).alias("__tm_n"))
    tagged = docs.withColumns({"__tm_r1": F.xxhash64("doc_id", "text"), "__tm_r2": F.xxhash64(F.lit(3), "doc_id", "text")}).join(kept, ["__tm_r1", "__tm_r2"])
    return tagged.withColumn("__tm_at", F.row_number().over(Window.partitionBy("__tm_r1", "__tm_r2").orderBy("doc_id"))).where("__tm_at <= __tm_n").select(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    plain = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return out.select(plain("doc").alias("doc_id"), plain("class").alias("class_id"), plain("rep").alias("rep_id"), "n_links")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(h, ',' ORDER BY h)) AS f FROM s GROUP BY doc_id),
g AS (SELECT f, min(doc_id) AS rep, count(*) AS weight, any_value(n) AS n FROM n GROUP BY f),
r AS (SELECT s.doc_id AS rep, s.h FROM s JOIN g ON s.doc_id = g.rep),
o AS (SELECT a.rep AS x, b.rep AS y, count(*) AS k FROM r a JOIN r b ON a.h = b.h AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN g gx ON o.x = gx.rep JOIN g gy ON o.y = gy.rep WHERE o.k * 10 >= 8 * (gx.n + gy.n - o.k)),
c AS (SELECT rep AS v, rep AS root FROM g UNION SELECT l.y, c.root FROM c JOIN l ON c.v = l.x),
m AS (SELECT v, min(root) AS class_id FROM c GROUP BY v),
k AS (SELECT g.rep, weight - 1 + coalesce(sum(w), 0) AS n_links FROM g LEFT JOIN (SELECT l.x, gy.weight AS w FROM l JOIN g gy ON l.y = gy.rep) z ON z.x = g.rep GROUP BY g.rep, weight)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(g.rep, d.doc_id) AS rep_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN g ON n.f = g.f LEFT JOIN m ON m.v = g.rep LEFT JOIN k ON k.rep = g.rep
"""
