"""The fuzzy neighbour graph and its layout."""

import math

import numpy as np
import pytest

from tidemark.operators import manifold as M
from tidemark.operators import neighbours as N
from tidemark.session import ship


@pytest.fixture(scope="module", autouse=True)
def package_on_workers(spark):
    ship(spark)


def trustworthiness(x, y, k=10):
    n = len(x)
    d, e = (((z[:, None] - z[None]) ** 2).sum(axis=2) for z in (x, y))
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = np.argsort(np.argsort(d, axis=1), axis=1) + 1
    near = np.argsort(e, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum()


def roll(n, seed=0):
    """A rolled sheet with noise in further dimensions."""
    rng = np.random.default_rng(seed)
    t = 1.5 * np.pi * (1 + 2 * rng.random(n))
    return np.concatenate([np.stack([t * np.cos(t), 20 * rng.random(n), t * np.sin(t)], 1), rng.normal(0, 0.1, (n, 3))], 1)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def test_memberships_sum_to_the_logarithm(spark):
    x = roll(150)
    x[:20] = x[0]  # copies
    rows = M.bandwidths(N.nearest(N.blocks_of(frame(spark, x)), 12)).collect()
    assert len(rows) == 150 and sum([n["p"] for n in r["near"]].count(1.0) < 2 for r in rows) > 100
    for r in rows:
        p = [n["p"] for n in r["near"]]
        assert max(p) == 1 and min(p) >= 0
        if p.count(1.0) < math.log2(12):  # more at the nearest distance leave no solution
            assert sum(p) == pytest.approx(math.log2(12), abs=1e-6)


def test_graph_is_the_fuzzy_union(spark):
    x = roll(80)
    members = M.bandwidths(N.nearest(N.blocks_of(frame(spark, x)), 6))
    p = {(r["id"], n["id"]): n["p"] for r in members.collect() for n in r["near"]}
    got = {(r["a"], r["b"]): r["w"] for r in M.fuzzy_graph(members).collect()}
    assert got.keys() == p.keys()
    for (a, b), w in got.items():
        q = p.get((b, a), 0.0)
        assert w == pytest.approx(p[a, b] + q - p[a, b] * q)
        assert (b, a) not in got or got[b, a] == pytest.approx(w)


def test_curve_meets_the_distance_rule():
    for min_dist in (0.0, 0.1, 0.5):
        a, b = M.curve(min_dist)
        d = np.linspace(0.01, 3, 200)
        goal = np.where(d < min_dist, 1, np.exp(-(d - min_dist)))
        assert np.abs(1 / (1 + a * d ** (2 * b)) - goal).max() < 0.1


@pytest.mark.parametrize("block_rows", [2048, 100])
def test_layout_keeps_neighbourhoods_better_than_components(spark, block_rows):
    x = roll(400)
    points = frame(spark, x)
    places = lambda df, c: np.array([r[c] for r in df.orderBy("id").collect()])
    laid = places(M.project(points, 2, 12, 0.1, rounds=4, blocks=N.blocks_of(points, block_rows)), "x")
    plain = trustworthiness(x, places(M.first_places(points, 2), "place"))
    assert trustworthiness(x, laid) > plain + 0.01


def test_layout_reruns_agree_whatever_the_partitions(spark):
    points = frame(spark, roll(120))
    one = M.project(points, 2, 8, rounds=2, epochs=10).orderBy("id").collect()
    two = M.project(points.repartition(7), 2, 8, rounds=2, epochs=10).orderBy("id").collect()
    assert np.allclose([r["x"] for r in one], [r["x"] for r in two], atol=1e-6)


def test_few_points(spark):
    assert M.project(frame(spark, np.array([[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]])), 2, 5, rounds=1, epochs=3).count() == 3


def test_grid_over_neighbours_marks_the_best(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import models

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (40, 4)) for c in (0, 4, 8)])
    score = lambda found: found.agg(F.lit(0.5).alias("npmi"), F.countDistinct("topic_id").alias("n_topics"), F.lit(3).cast("long").alias("n_pairs"))
    got = models.neighbour_grid(frame(spark, x), score, [("a", 6, 0.0), ("b", 12, 0.1)], 2, 10, 5, rounds=2).collect()
    assert [(r["label"], r["n_neighbors"], r["min_dist"], r["best"]) for r in got] == [("a", 6, 0.0, True), ("b", 12, 0.1, False)]
    assert all(r["n_topics"] >= 3 and 0 <= r["noise_rate"] < 0.5 and r["time_sec"] > 0 for r in got)
