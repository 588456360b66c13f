"""Projection of vectors to few dimensions that keeps neighbourhoods: a fuzzy graph of nearest neighbours, laid out by parts.

Each point's distances become memberships exp(-(d - rho) / sigma), rho its nearest distance and sigma such that they sum to the
logarithm (base 2) of their number. A pair's weight is the fuzzy union of both directions.

The layout starts from the principal components. In each round every part - a block of nearby points - draws edges by their weight
for some epochs, pulls its own points along them and pushes them from points drawn among those that it sees: its own, their
neighbours, and a fixed number drawn from all. Neighbours in other parts stay where the round found them. A part holds its
points, their neighbour lists and the neighbours' places, so its size is bounded whatever the number of points, and a point that is
everyone's neighbour costs no more than any other: points are moved along the edges of their own list alone. Draws depend on seed, round
and part, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import neighbours as N
from tidemark.tables import small, written

STEPS, WIDEST, NARROWEST = 50, 100.0, 1e-3
ROUNDS, EPOCHS, PUSHES, SEEN, REACH = 6, 40, 5, 512, 10.0


def bandwidth(d: np.ndarray) -> tuple[float, float]:
    """(rho, sigma) of a point's distances, nearest first."""
    rho, mean, goal = float(d[0]), float(d.mean()), math.log2(len(d)) if len(d) > 1 else 1.0
    low, high = 0.0, WIDEST * mean
    for _ in range(STEPS):
        middle = (low + high) / 2
        if middle > 0 and np.exp(-np.maximum(0, d - rho) / middle).sum() > goal:
            high = middle
        else:
            low = middle
    return rho, max((low + high) / 2, NARROWEST * mean)


def bandwidths(near: DataFrame) -> DataFrame:
    """id, rho, sigma, near (id, p): the memberships of each point's neighbours. ``near``: id, near; points without neighbours are left out."""

    @F.pandas_udf("struct<rho:double,sigma:double>")
    def fitted(d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bandwidth(np.asarray(x, float)) for x in d], columns=["rho", "sigma"])

    rows = near.where(F.size("near") > 0).withColumn("b", fitted(F.col("near.d")))
    p = lambda n: F.when(F.col("b.sigma") > 0, F.exp(-F.greatest(F.lit(0.0), n["d"] - F.col("b.rho")) / F.col("b.sigma"))).otherwise(1.0)
    return rows.select("id", "b.rho", "b.sigma", F.transform("near", lambda n: F.struct(n["id"].alias("id"), p(n).alias("p"))).alias("near"))


def fuzzy_graph(members: DataFrame) -> DataFrame:
    """a, b, w: the union p + q - p q of both directions' memberships, for each edge of a's list."""
    one = small(members.select(F.col("id").alias("a"), F.explode("near").alias("n")).select("a", F.col("n.id").alias("b"), F.col("n.p").alias("p")), "memberships")
    back = one.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("p").alias("q"))
    q = F.coalesce("q", F.lit(0.0))
    return one.join(back, ["a", "b"], "left").select("a", "b", (F.col("p") + q - F.col("p") * q).alias("w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a d^2b) comes closest to 1 up to ``min_dist`` and exponential decay beyond."""
    d = np.linspace(1e-3, 3 * spread, 300)
    goal = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p, damping = np.array([1.0, 1.0]), 1e-2
    value = lambda p: 1 / (1 + p[0] * d ** (2 * p[1]))
    for _ in range(200):
        f = value(p)
        slope = -(f**2)[:, None] * np.stack([d ** (2 * p[1]), 2 * p[0] * d ** (2 * p[1]) * np.log(d)], 1)
        square = slope.T @ slope
        step = np.linalg.solve(square + damping * np.diag(np.diag(square)), slope.T @ (goal - f))
        new = np.maximum(p + step, 1e-3)
        better = ((goal - value(new)) ** 2).sum() < ((goal - f) ** 2).sum()
        p, damping = (new, damping / 3) if better else (p, damping * 4)
    return float(p[0]), float(p[1])


def first_places(points: DataFrame, dims: int) -> DataFrame:
    """id, place: principal components, scaled to reach ``REACH``."""
    ready = points.select("id", array_to_vector("x").alias("v"))
    spots = PCA(k=dims, inputCol="v", outputCol="p").fit(ready).transform(ready).select("id", vector_to_array("p").alias("p"))
    mean = spots.agg(*[F.avg(F.col("p")[i]).alias(f"m{i}") for i in range(dims)]).first()
    moved = spots.select("id", F.array(*[F.col("p")[i] - (mean[i] or 0.0) for i in range(dims)]).alias("p"))
    far = moved.agg(F.max(F.array_max(F.transform("p", F.abs)))).first()[0] or 1.0
    # A little noise by id parts copies.
    noise = lambda i: (F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3
    return moved.select("id", F.array(*[F.col("p")[i] * (REACH / far) + noise(i) for i in range(dims)]).alias("place"))


def laid_out(dims: int, a: float, b: float, seed: int, step: int, rounds: int, epochs: int, sample: np.ndarray) -> Callable:
    """One round of one part: new places of its own points."""

    def run(key: tuple, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own, edges = own.sort_values("id"), edges.sort_values(["a", "b"])
        ids = own["id"].to_numpy(np.int64)
        others = edges.drop_duplicates("b").loc[lambda e: ~e["b"].isin(ids)]
        names = np.concatenate([ids, others["b"].to_numpy(np.int64)])
        spots = [np.stack(own["place"].to_numpy())] + ([np.stack(others["spot"].to_numpy())] if len(others) else []) + ([sample] if len(sample) else [])
        y = np.concatenate(spots).astype(float)
        order = np.argsort(names, kind="stable")
        head = np.searchsorted(ids, edges["a"].to_numpy(np.int64))
        tail = order[np.searchsorted(names, edges["b"].to_numpy(np.int64), sorter=order)]
        chance = edges["w"].to_numpy(float)
        chance = chance / max(chance.max(initial=0), 1e-12)
        rng = np.random.Generator(np.random.PCG64([seed, step, int(key[0]) & (2**63 - 1)]))
        for epoch in range(epochs):
            rate = 1 - (step * epochs + epoch) / (rounds * epochs)
            drawn = np.flatnonzero(rng.random(len(chance)) < chance)
            h, t = head[drawn], tail[drawn]
            gap = y[h] - y[t]
            square = (gap**2).sum(axis=1)
            pull = np.where(square > 0, -2 * a * b * np.maximum(square, 1e-12) ** (b - 1) / (1 + a * square**b), 0)
            move = np.zeros((len(ids), dims))
            np.add.at(move, h, np.clip(pull[:, None] * gap, -4, 4))
            h = np.repeat(h, PUSHES)
            t = rng.integers(len(y), size=len(h))
            gap = y[h] - y[t]
            square = (gap**2).sum(axis=1)
            push = np.where(h == t, 0, 2 * b / ((0.001 + square) * (1 + a * square**b)))
            np.add.at(move, h, np.clip(push[:, None] * gap, -4, 4))
            y[: len(ids)] += rate * np.clip(move, -4, 4)
        return pd.DataFrame({"id": ids, "place": list(y[: len(ids)])})

    return run


def project(points: DataFrame, dims: int = 5, n_neighbors: int = 15, min_dist: float = 0.0, seed: int = 42, rounds: int = ROUNDS, epochs: int = EPOCHS, blocks: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """id, x: places in ``dims`` dimensions. ``points``: id, x, of length one where distances should order as cosines do; ``blocks`` and ``near``, longer lists too, may be given."""
    blocks = N.blocks_of(points) if blocks is None else blocks
    near = N.nearest(blocks, n_neighbors) if near is None else near.select("id", F.slice("near", 1, n_neighbors).alias("near"))
    edges = written(fuzzy_graph(bandwidths(near)), "graph")

    @F.pandas_udf("array<long>")
    def members(ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, "<i8") for b in ids])

    part = small(blocks.select(F.col("number").alias("part"), F.explode(members("ids")).alias("id")), "parts")
    pulled = written(edges.join(part.withColumnRenamed("id", "a"), "a"), "pulled")
    places = written(first_places(points, dims), "places")
    a, b = curve(min_dist)
    for step in range(rounds):
        seen = places.orderBy(F.xxhash64(F.lit(step), "id"), "id").limit(SEEN).collect()
        sample = np.array([r["place"] for r in seen], float).reshape(len(seen), dims)
        own = places.join(part, "id")
        known = pulled.join(places.select(F.col("id").alias("b"), F.col("place").alias("spot")), "b").select("part", "a", "b", "w", "spot")
        moved = own.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(laid_out(dims, a, b, seed, step, rounds, epochs, sample), "id long, place array<double>")
        places = written(moved, "places")
    return places.select("id", F.col("place").alias("x"))
