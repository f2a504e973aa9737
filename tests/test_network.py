"""Networks drawn at random, against plain searches."""

import heapq
import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from railweave import api
from railweave.functions.polygons import ring_area, union
from railweave.operators import areas
from railweave.operators import network as net
from railweave.sources import streets
from railweave.sources.streets import load_network, read_matrix, write_matrix


def town(seed=1, n=24, m=70):
    """``(places, edges)``: nodes scattered over two kilometres, directed edges with lengths and times, some doubled, some impassable."""
    rng = np.random.default_rng(seed)
    places = {int(k): (float(x), float(y)) for k, (x, y) in zip(rng.permutation(1000)[:n] + 11, rng.uniform(-1000, 1000, (n, 2)).round(1))}
    ids = sorted(places)
    edges = [(int(rng.choice(ids)), int(rng.choice(ids)), None if k % 19 == 7 else float(rng.integers(5, 90)), float(rng.integers(20, 700))) for k in range(m)]
    return places, edges + edges[:6]


def tables(spark, places, edges):
    nodes = spark.createDataFrame([(k, *p) for k, p in places.items()], "node_id long, x double, y double")
    return nodes, spark.createDataFrame(edges, "from_node long, to_node long, tts double, length double")


def entries(edges):
    """Of parallel edges each weight's least; loops go, missing weights are infinite."""
    out = {}
    for a, b, *w in edges:
        if a != b:
            w = [np.inf if v is None else v for v in w]
            out[a, b] = tuple(map(min, out.get((a, b), (np.inf, np.inf)), w))
    return out


def search(kept, starts, weight=0, limit=np.inf):
    """``{node: (cost, edges, node before)}``, ties by fewer edges and the smaller node before."""
    out, heap = {}, [(0.0, 0, -1, s) for s in starts]
    heapq.heapify(heap)
    while heap:
        c, n, before, v = heapq.heappop(heap)
        if v not in out:
            out[v] = (c, n, before)
            for (a, b), w in kept.items():
                if a == v and c + w[weight] <= limit and w[weight] < np.inf:
                    heapq.heappush(heap, (c + w[weight], n + 1, v, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matrix(spark, seed):
    places, edges = town(seed)
    known = dict(list(places.items())[:-3])
    nodes, listed = tables(spark, known, edges)
    at = lambda c, i: F.when(F.col(c) >= 0, F.element_at(F.create_map(*[F.lit(x) for k, p in places.items() for x in (k, p[i])]), F.col(c)))
    listed = listed.withColumns({"from_x": at("from_node", 0), "from_y": at("from_node", 1), "to_x": at("to_node", 0), "to_y": at("to_node", 1)})
    m = net.build_matrix(nodes, listed, ("tts", "length", "absent"), meta={"default_weight": "length"})
    assert m.weights == ("tts", "length") and m.default_weight == "length"
    kept = entries(edges)
    assert {(r["src"], r["dst"]): (r["tts"], r["length"]) for r in net.matrix_edges(m).collect()} == kept
    rows = {r["node_id"]: r for r in m.nodes.collect()}
    froms, tos = [e[0] for e in edges if e[0] not in known], [e[1] for e in edges if e[1] not in known]
    assert [v for v, _ in sorted(rows.items(), key=lambda x: x[1]["row"])] == [*known, *dict.fromkeys(froms + tos)]
    assert all((r["x"], r["y"]) == places[v] and r["in_area"] == (v in known) for v, r in rows.items())
    indptr, indices, data = net.csr(m, "tts")
    order = [v for v, _ in sorted(rows.items(), key=lambda x: x[1]["row"])]
    again = {(order[i], order[j]): w for i in range(len(order)) for j, w in zip(indices[indptr[i] : indptr[i + 1]], data[indptr[i] : indptr[i + 1]])}
    assert again == {k: w[0] for k, w in kept.items()} and all((np.diff(indices[a:b]) > 0).all() for a, b in zip(indptr, indptr[1:]))
    assert [(r["start"], r["size"]) for r in net.row_offsets(m).orderBy("row").collect()] == list(zip(indptr[:-1], np.diff(indptr)))
    for bad in (lambda: net.build_matrix(nodes.union(nodes.limit(1)), listed, ("tts",)), lambda: net.build_matrix(nodes, listed, ("absent",))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        m.weight("absent")


@pytest.mark.parametrize("kernel", [10**6, 0])
def test_costs(spark, kernel):
    places, edges = town(3)
    kept = entries(edges)
    starts = [*sorted(places)[:3], 5_000]
    table = spark.createDataFrame([(a, b, w[0], w[1]) for (a, b), w in kept.items()], "src long, dst long, tts double, length double")
    origins = spark.createDataFrame([(s,) for s in starts], "origin long")
    found = {}
    for r in net.travel_costs(table, origins, "tts", 160.0, extra=["length"], kernel_edges=kernel).collect():
        found.setdefault(r["origin"], {})[r["node"]] = r
    for s in starts:
        want = search(kept, [s], limit=160.0)
        assert {v: (r["cost"], r["n_edges"], r["before"]) for v, r in found[s].items()} == {v: (c, n, None if b < 0 else b) for v, (c, n, b) in want.items()}
        for v, (_, _, before) in want.items():
            if before >= 0:
                assert found[s][v]["length"] == found[s][before]["length"] + kept[before, v][1]
    merged = {r["node"]: r["cost"] for r in net.travel_costs(table, origins, "length", None, merged=True).collect()}
    assert merged == {v: c for v, (c, _, _) in search(kept, starts, 1).items()}


def test_pairs_and_lines(spark):
    places, edges = town(4)
    nodes, listed = tables(spark, places, edges)
    m, kept, ids = net.build_matrix(nodes, listed, ("tts", "length")), entries(edges), sorted(places)
    starts, ends = [ids[5], ids[2], ids[5]], [ids[7], ids[2], ids[11], ids[0]]
    out = api.shortest_path(m, starts, ends, 2.0, spark=spark).collect()
    want = []
    for s, e in itertools.product(starts, ends):
        tree = search(kept, [s], limit=120.0)
        if e in tree:
            path = [e]
            while tree[path[0]][2] >= 0:
                path.insert(0, tree[path[0]][2])
            want.append((s, e, pytest.approx(tree[e][0] / 60), sum(kept[x][1] for x in zip(path, path[1:])), len(path) - 1, None if s == e else [places[v] for v in path]))
    assert [(r["origin"], r["destination"], r["time_min"], r["length_m"], r["n_edges"], r["line"] and [(p["x"], p["y"]) for p in r["line"]]) for r in out] == want and len(want) > 4
    assert "line" not in api.shortest_path(m, ids[0], ids[1], None, geometry=False, spark=spark).columns


def test_reach_and_isochrones_against_a_raster(spark):
    places, edges = town(6)
    nodes, listed = tables(spark, places, edges)
    m, kept, ids = net.build_matrix(nodes, listed, ("tts", "length")), entries(edges), sorted(places)
    start, minutes = max(ids, key=lambda v: len(search(kept, [v], limit=90.0))), [0.5, 1.5]
    iso = api.isochrones(m, start, minutes, spark=spark, buffer_distance=30.0, tile=300.0).collect()
    rng = np.random.default_rng(0)
    px, py = rng.uniform(-1100, 1100, (2, 30_000))
    for cutoff in minutes:
        tree = search(kept, [start], limit=cutoff * 60)
        mine = [r for r in iso if r["cutoff"] == cutoff]
        assert {r["n_nodes"] for r in mine} == {len(tree)}
        covered = np.zeros(len(px), bool)
        for (a, b), w in kept.items():
            if a in tree and w[0] < np.inf and cutoff * 60 - tree[a][0] > 0:
                p, q = np.array(places[a]), np.array(places[b])
                q = p + min(1.0, (cutoff * 60 - tree[a][0]) / w[0]) * (q - p)
                t = np.clip(((px - p[0]) * (q - p)[0] + (py - p[1]) * (q - p)[1]) / max(((q - p) ** 2).sum(), 1e-9), 0, 1)
                covered |= np.hypot(px - p[0] - t * (q - p)[0], py - p[1] - t * (q - p)[1]) <= 30.0
        hits = np.zeros(len(px), int)
        for r in mine:
            odd = np.zeros(len(px), bool)
            for ring in r["rings"]:
                c = np.array([(p["x"], p["y"]) for p in ring])
                d = np.roll(c, -1, axis=0)
                for (x1, y1), (x2, y2) in zip(c, d):
                    if y1 != y2:
                        odd ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
            hits += odd
        assert hits.max() == 1 and (hits.astype(bool) != covered).mean() < 0.004  # round ends have eight corners
        assert sum(r["area"] for r in mine) == pytest.approx(covered.mean() * 2200**2, rel=0.08)
    hull = api.isochrones(m, [start, ids[1]], 1.5, merge_origins=True, method="hull", spark=spark).collect()
    assert len(hull) == 1 and hull[0]["area"] > 0 and hull[0]["origin"] == f"{start};{ids[1]}"
    for bad in ([], -3, "7", [2, 0], False):
        with pytest.raises(ValueError):
            net.cutoffs_of(bad, "tts")
    assert net.cutoffs_of([7, 3, 7], "tts") == [(3, 180.0), (7, 420.0)] and net.cutoffs_of(7, "length") == [(7, 7.0)]


def test_snapping(spark, rows):
    places, edges = town(7)
    nodes, listed = tables(spark, places, edges)
    m, kept = net.build_matrix(nodes, listed, ("tts", "length")), entries(edges)
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-900, 900, (30, 2)))]
    found = {r["point_id"]: (r["node_id"], r["distance"]) for r in net.snap(rows("point_id int, x double, y double", *pts), nodes, 400.0, strict=False).collect()}
    for i, x, y in pts:
        d, v = min((float(np.hypot(p[0] - x, p[1] - y)), v) for v, p in places.items())
        assert found.get(i) == ((v, pytest.approx(d)) if d <= 400 else None)
    starts = {a for a, _ in kept}
    x, y = places[max(starts)]
    assert api.shortest_path(m, (x + 1, y - 1), max(starts), geometry=False, spark=spark).first()["origin"] == max(starts)
    for bad in ((9e6, 9e6), 123_456):
        with pytest.raises(ValueError):
            api.shortest_path(m, bad, max(starts), geometry=False, spark=spark)
    tie = net.snap(rows("point_id int, x double, y double", (4, 3.0, 9.0)), rows("node_id int, x double, y double", (8, 3.0, 2.0), (6, 3.0, 16.0), (2, None, 9.0)), 7.0)
    assert tie.first()["node_id"] == 6


def test_files(spark, tmp_path):
    m = net.build_matrix(*tables(spark, *town(8)), ("tts", "length"), meta={"layer": "bike"})
    path = write_matrix(m, tmp_path / "made" / "bike" / "matrix.npz")
    again = read_matrix(spark, path)
    assert all((a == b).all() for w in m.weights for a, b in zip(net.csr(m, w), net.csr(again, w))) and again.meta["layer"] == "bike"
    assert load_network(spark, tmp_path / "made", "bike").n_nodes() == m.n_nodes()
    with pytest.raises(ValueError):
        load_network(spark, tmp_path / "made")
    with np.load(path) as data:
        arrays = dict(data)
    for k, v in {"node_x": None, "indices": arrays["indices"][1:], "meta": np.array('{"format_version": 99}')}.items():
        np.savez(tmp_path / "bad.npz", **{**{a: b for a, b in arrays.items() if a != k}, **({} if v is None else {k: v})})
        with pytest.raises(ValueError):
            read_matrix(spark, tmp_path / "bad.npz")


def checksum(network):
    ids = network.nodes.select("row", "node_id", "x", "y", "in_area")
    told = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first())
    return told(ids), told(network.edges.select("row", "col", *network.weights))


def test_large_files_pass_the_driver_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streets, "PART_BYTES", 1 << 20, raising=False)
    n = 150_000
    nodes = spark.range(n).select(F.col("id").alias("row"), (F.col("id") * 7 + 3).alias("node_id"), F.rand(1).alias("x"), F.rand(2).alias("y"), (F.col("id") % 3 == 0).alias("in_area")).localCheckpoint()
    # one row has more entries than are read at once, some have two, most have none
    pairs = spark.range(80_000).select(F.floor(F.col("id") / 2).alias("row"), (F.col("id") % 2).alias("col")).unionByName(spark.range(2, n).select(F.lit(777).cast("long").alias("row"), F.col("id").alias("col")))
    edges = pairs.select("row", "col", F.when(F.col("col") % 11 == 5, F.lit(np.inf)).otherwise(F.xxhash64("row", "col") / 1e9).alias("tts"), F.hash("col", "row").cast("double").alias("length"))
    made = net.Network(nodes.repartition(3), edges.repartition(5, "col").localCheckpoint(), ("tts", "length"), {"default_weight": "length", "layer": "bike"})
    tracemalloc.start()
    again = read_matrix(spark, write_matrix(made, tmp_path / "matrix.npz"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6
    assert checksum(again) == checksum(made) and again.weights == made.weights and again.default_weight == "length"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["matrix.npz"]
    with np.load(tmp_path / "matrix.npz") as data:
        indptr, indices, lengths = net.csr(made, "length")
        assert (data["indptr"] == indptr).all() and (data["indices"] == indices).all() and (data["data"] == lengths).all() and (data["w_length"] == lengths).all()
        assert data["indptr"].dtype == data["indices"].dtype == np.int32 and data["shape"].tolist() == [n, n] and str(data["format"]) == "csr"
        assert (data["node_id"] == np.arange(n) * 7 + 3).all() and set(data["node_layer"]) == {"bike"} and (data["node_in_area"] == (np.arange(n) % 3 == 0)).all()


@pytest.mark.parametrize("ids", [["a", "Ñandú 木", "b"], []])
def test_files_of_text_ids(spark, tmp_path, ids):
    nodes = spark.createDataFrame([(i, v, None if i else 1.5, 2.0, True, f"layer{i}") for i, v in enumerate(ids)], "row long, node_id string, x double, y double, in_area boolean, layer string")
    edges = spark.createDataFrame([(2, 0, 4.0), (0, 1, np.inf)][: len(ids)], "row long, col long, w double")
    again = read_matrix(spark, write_matrix(net.Network(nodes, edges, ("w",)), tmp_path / "matrix.npz"))
    assert {(r["src"], r["dst"], r["w"]) for r in net.matrix_edges(again).collect()} == ({("b", "a", 4.0), ("a", "Ñandú 木", np.inf)} if ids else set())
    assert [(r["node_id"], r["layer"]) for r in again.nodes.orderBy("row").collect()] == [(v, f"layer{i}") for i, v in enumerate(ids)]
    if ids:
        with pytest.raises(ValueError):
            write_matrix(net.Network(nodes.withColumn("node_id", F.nullif("node_id", F.lit("b"))), edges, ("w",)), tmp_path / "lost.npz")


def test_components(spark):
    _, edges = town(9, n=60, m=45)
    root = {}

    def top(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b, *_ in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    found = {r["node"]: r["component"] for r in net.components(spark.createDataFrame([(a, b) for a, b, *_ in edges], "src long, dst long")).collect()}
    assert found == {v: top(v) for v in list(root)} and len(set(found.values())) >= 3


def test_unions_of_polygons(spark):
    boxes = [[(x, y), (x + 30, y), (x + 30, y + 20), (x, y + 20)] for x, y in ((0, 0), (10, 10), (70, 0), (40, 5))]
    inside = np.zeros((200, 120), bool)
    for b in boxes:
        inside[b[0][0] : b[2][0], b[0][1] : b[2][1]] = True
    rings = union([[b] for b in boxes])
    assert sum(map(ring_area, rings)) == pytest.approx(inside.sum()) and len(rings) == 1
    frame = union([[[(0, 0), (9, 0), (9, 3), (0, 3)]], [[(0, 6), (9, 6), (9, 9), (0, 9)]], [[(0, 0), (3, 0), (3, 9), (0, 9)]], [[(6, 0), (9, 0), (9, 9), (6, 9)]]])
    assert sorted(map(ring_area, frame)) == [-9, 81]
    shapes = spark.createDataFrame([("a", [[{"x": float(x), "y": float(y)} for x, y in b]]) for b in boxes], "k string, rings array<array<struct<x: double, y: double>>>")
    assert areas.dissolved(shapes, "k").first()["area"] == pytest.approx(inside.sum()) and union([]) == []
