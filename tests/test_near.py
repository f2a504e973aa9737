import numpy as np
import pandas as pd
import pytest

from railweave.operators.near import QuadTree, RTree, inside, near_pairs, regions_holding


def brute(points, distance):
    best = set()
    for i, (a, x, y) in enumerate(points):
        for b, u, v in points[i + 1 :]:
            if a is not None and b is not None and a != b and np.hypot(x - u, y - v) <= distance:
                best.add((min(a, b), max(a, b)))
    return best


@pytest.mark.parametrize("sizes", [dict(), dict(sample=200, leaf=20, block=15)])
def test_against_brute_force(spark, sizes):
    rng = np.random.default_rng(5)
    xs = np.r_[rng.normal(0, 60, 300), rng.uniform(-1000, 1000, 300), np.full(40, 7.0)]
    ys = np.r_[rng.normal(0, 60, 300), rng.uniform(-1000, 1000, 300), np.full(40, -7.0)]
    points = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(points, "id long, x double, y double").withColumnRenamed("id", "node_id")
    found = [tuple(r) for r in near_pairs(df, "node_id", "x", "y", 25.0, **sizes).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(points, 25.0)


def test_nulls_repeats_exact_distance_and_clashing_names(rows):
    df = rows("node_id long, x double, y double, leaf int, own boolean, id int", (1, 0.0, 0.0, 1, True, 1), (1, 0.0, 0.0, 1, True, 1), (2, 15.0, 20.0, 1, None, 1), (3, 15.0, 20.1, 1, None, 1), (4, None, 0.0, 1, None, 1), (5, float("nan"), 0.0, 1, None, 1), (None, 0.0, 0.0, 1, None, 1), (6, float("inf"), 0.0, 1, None, 1))
    assert {tuple(r) for r in near_pairs(df, "node_id", "x", "y", 25.0).collect()} == {(1, 2), (2, 3)}
    assert near_pairs(df.limit(0), "node_id", "x", "y", 25.0).count() == 0
    with pytest.raises(ValueError):
        near_pairs(df, "node_id", "x", "y", -1.0)


def test_regions_with_a_notch(spark, rows):
    ring = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0)]
    parts = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in ring]), (2, None), (3, [{"x": 0.0, "y": 0.0}])], "part_no int, ring array<struct<x: double, y: double>>")
    pts = rows("node_id long, x double, y double", (1, 1.0, 1.0), (2, 5.0, 8.0), (3, 0.0, 5.0), (4, 20.0, 5.0), (5, None, 1.0), (1, 1.0, 1.0))
    for corners in (500_000, 2):
        assert {tuple(r) for r in regions_holding(pts, "node_id", "x", "y", parts, "part_no", "ring", max_corners=corners).collect()} == {(1, 1), (1, 3)}


def test_trees():
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 100, 500), rng.uniform(0, 100, 500)
    q, i = RTree(x, y, x, y).probe(x - 5, y - 5, x + 5, y + 5)
    near = np.abs(x[:, None] - x) <= 5
    assert set(zip(q, i)) == set(zip(*np.nonzero(near & (np.abs(y[:, None] - y) <= 5))))
    tree = QuadTree(x, y, 20, 1.0)
    assert np.bincount(tree.home(x, y)).max() <= 20 and set(tree.home(x, y)) <= set(tree.touched(-1e9, -1e9, 1e9, 1e9))
    assert RTree(x[:0], y[:0], x[:0], y[:0]).probe(x, y, x, y)[0].size == 0
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    assert list(inside(np.array([0.5, 1.0, 1.5]), np.array([0.5, 0.5, 0.5]), square)) == [True, True, False]


def test_leaves_hold_as_many_points_whatever_the_size(spark):
    from railweave.operators.near import sampled_tree

    pts = spark.range(300_000).selectExpr("id", "pmod(hash(id, 1), 1000003) / 1.0 as x", "pmod(hash(id, 2), 1000003) / 1.0 as y")
    for n in (30_000, 300_000):
        some = pts.where(f"id < {n}")
        tree = sampled_tree(some, n, 1.0, sample=100, leaf=1_000)
        at = some.toPandas()
        held = np.bincount(tree.home(at["x"].to_numpy(), at["y"].to_numpy()))
        assert held.max() < 2_500 and held.mean() > 200


@pytest.mark.parametrize("corners", [500_000, 50])
def test_many_regions_against_brute_force(spark, corners):
    rng = np.random.default_rng(8)
    pts = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (400, 2)))]
    rings = {k: [(float(x), float(y)), (float(x + w), float(y)), (float(x + w / 2), float(y + w))] for k, (x, y, w) in enumerate(zip(rng.uniform(0, 90, 60), rng.uniform(0, 90, 60), rng.uniform(1, 40, 60)))}
    df = spark.createDataFrame(pts, "id long, x double, y double")
    parts = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in rings.items()], "part int, ring array<struct<x: double, y: double>>")
    found = {tuple(r) for r in regions_holding(df, "id", "x", "y", parts, "part", "ring", max_corners=corners).collect()}
    px, py = np.array([p[1] for p in pts]), np.array([p[2] for p in pts])
    expected = {(k, int(i)) for k, r in rings.items() for i in np.flatnonzero(inside(px, py, np.array([*r, r[0]])))}
    assert found == expected and len(expected) > 100
