"""Queries over whole query sets, against brute force on small tables of their own."""

import datetime as dt
import heapq

import numpy as np
import pytest

from railweave.operators import areas
from railweave.plans import transport

NODES = "layer string, node_id long, x double, y double, in_area boolean, loaded_at timestamp"
EDGES = "edge_row long, from_node long, to_node long, length double, tts double"
AT = dt.datetime(2018, 1, 1)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """``(directory, nodes, edges)``: 12 x 12 nodes in a ring road and random streets, 15 of them divisible by 100."""
    d, rng = tmp_path_factory.mktemp("small"), np.random.default_rng(11)
    ids = [i * 10 for i in range(144)]
    nodes = {v: (400.0 * (k % 12), 400.0 * (k // 12)) for k, v in enumerate(ids)}
    pairs = [(a, b) for a, b in zip(ids, ids[1:])] + [(int(a), int(b)) for a, b in rng.choice(ids, (250, 2))]
    edges = [(k, a, b, float(rng.integers(50, 900)), float(rng.integers(20, 300)) if k % 17 else None) for k, (a, b) in enumerate(pairs)]
    listed = [("walking", v, x, y, True, AT) for v, (x, y) in nodes.items()] + [("walking", 2000, None, None, None, AT)]
    spark.createDataFrame(listed, NODES).coalesce(1).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([*edges, (999, 100, 2000, 1.0, 1.0)], EDGES).coalesce(1).write.parquet(f"{d}/edges.parquet")
    return str(d), nodes, edges


def searched(edges, starts, weight, limit):
    out = {}
    for a, b, w in [(e[1], e[2], e[weight]) for e in edges]:
        if a != b and w is not None:
            out.setdefault(a, []).append((b, w))
    best, heap = {}, [(0.0, s) for s in starts]
    while heap:
        c, n = heapq.heappop(heap)
        if n not in best:
            best[n] = c
            for b, w in out.get(n, ()):
                if c + w <= limit:
                    heapq.heappush(heap, (c + w, b))
    return best


def test_searches_from_the_whole_query_set(spark, small):
    d, _, edges = small
    starts = sorted({e[1] for e in edges if e[1] % 100 == 0})
    assert len(starts) > 10
    costs = {o: searched(edges, [o], 4, 600.0) for o in starts}
    found = transport.costs_limited(spark, d).collect()
    assert {(r["origin"], r["node"]): r["cost"] for r in found} == {(o, n): c for o in starts for n, c in costs[o].items()}
    assert len(found) == sum(map(len, costs.values()))
    merged = transport.costs_merged_origins(spark, d).collect()
    assert {r["node"]: r["cost"] for r in merged} == searched(edges, starts, 3, 2500.0) and len({r["node"] for r in merged}) == len(merged)
    ends = set(starts) | {e[2] for e in edges if e[1] in starts and e[1] != e[2]}
    pairs = transport.shortest_pairs(spark, d).collect()
    assert {(r["origin"], r["destination"]): r["time_min"] for r in pairs} == {(o, n): round(c / 60, 6) for o in starts for n, c in costs[o].items() if n in ends}
    assert len(pairs) == len({(r["origin"], r["destination"]) for r in pairs})
    counts = {(r["origin"], r["cutoff"]): r["n_nodes"] for r in transport.reach_counts(spark, d).collect()}
    assert counts == {(o, m): sum(c <= m * 60 for c in costs[o].values()) for o in starts for m in (2.0, 5.0, 10.0)}
    least = {}
    for _, a, b, _, w in edges:
        if a != b and w is not None:
            least[a, b] = min(w, least.get((a, b), w))
    parts = {(o, a, b): min((600.0 - costs[o][a]) / w, 1.0) for o in starts for (a, b), w in least.items() if a in costs[o] and costs[o][a] < 600.0}
    assert {(r["origin"], r["src"], r["dst"]): r["fraction"] for r in transport.reach_segments(spark, d).collect()} == pytest.approx(parts, abs=1e-6)


def test_shares_of_the_query_set_in_all_rectangles(spark, small):
    d, nodes, _ = small
    want = {}
    for a, (ax, ay) in nodes.items():
        for b, (bx, by) in nodes.items():
            w, h = min(ax + 9000, bx + 5000) - max(ax, bx), min(ay + 4500, by + 2500) - max(ay, by)
            if a % 100 == 0 and w > 0 and h > 0:
                want[a, b] = (w * h / (9000 * 4500), w * h / (5000 * 2500))
    found = transport.area_shares(spark, d).collect()
    assert len(found) == len(want) and {a for a, _ in want} == {v for v in nodes if v % 100 == 0} and len({b for _, b in want}) == len(nodes)
    for r in found:
        assert (r["of_area"], r["of_region"]) == pytest.approx(want[r["area_id"], r["region_id"]], abs=1e-6)


def test_rectangles_by_their_boxes_and_other_shapes_by_slabs(spark):
    shapes = {1: [(0, 0), (4, 0), (4, 4), (0, 4)], 2: [(2, 2), (2, 6), (6, 6), (6, 2), (2, 2)], 3: [(0, 0), (4, 4), (4, 0), (0, 4)], 4: [(0, 0), (4, 0), (0, 4)], 5: [(4, 0), (8, 0), (8, 4), (4, 4)]}
    ring = "id long, rings array<array<struct<x: double, y: double>>>"
    df = spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in r]]) for k, r in shapes.items()], ring)
    found = {(r["area_id"], r["region_id"]): r for r in areas.overlaps(df, df, 3.0).collect()}
    want = {(a, b): areas.overlap_area([shapes[a]], [shapes[b]]) for a in shapes for b in shapes}
    assert {k: r["shared"] for k, r in found.items()} == pytest.approx({k: v for k, v in want.items() if v > 0})
    assert all((r["area_size"], r["region_size"]) == pytest.approx((want[a, a], want[b, b])) for (a, b), r in found.items())
