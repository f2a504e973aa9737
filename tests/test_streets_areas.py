import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from railweave.functions import geo, proj, tags, text
from railweave.operators import areas, report, streets
from railweave.sources.sinks import collection, geojson_lines, node_link, write_layers, write_report, write_schedule
from railweave.sources.streets import TemporaryFailure, read_elements, read_geojson, read_graph, street_networks, with_retries
from railweave.sources.timetables import catalogue_files, fetch_files

LINE = "array<struct<x: double, y: double>>"


def line(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_topology_and_split(spark):
    edges = spark.createDataFrame([(1, 30.0, line((0, 0), (10, 0), (20, 0))), (2, 10.0, line((20, 0), (20, 10))), (3, 10.0, line((20, 0), (30, 0))), (4, 7.0, line((50, 50), (50, 50)))], f"edge int, length double, geometry {LINE}")
    nodes = {(r["kx"], r["ky"]): r for r in streets.topology_nodes(edges).collect()}
    assert {k: r["node_role"] for k, r in nodes.items()} == {(0, 0): "endpoint", (10, 0): "linear_vertex", (20, 0): "intersection", (20, 10): "endpoint", (30, 0): "endpoint", (50, 50): "isolated_vertex"}
    assert nodes[20, 0]["incident_segments"] == 3 and nodes[20, 0]["incident_features"] == 3
    both = edges.unionByName(edges.where("edge = 2").withColumn("edge", F.lit(9)).withColumn("geometry", F.reverse("geometry")))
    assert streets.topology_nodes(both).where("kx = 20 and ky = 10").first()["node_role"] == "through_endpoint"
    assert streets.topology_nodes(both, undirected=True).where("kx = 20 and ky = 10").first()["node_role"] == "endpoint"
    parts = streets.split_edges(edges, streets.name_nodes(streets.topology_nodes(edges), "w")).orderBy("edge", "part").collect()
    assert [(r["edge"], r["part"], r["length"]) for r in parts][:3] == [(1, 1, 15.0), (1, 2, 15.0), (2, 1, 10.0)]
    assert parts[0]["to_node"] == parts[1]["from_node"]


def test_street_layers(spark):
    vertices = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 100.0, 0.0, "stop")], "node_id long, x double, y double, highway string")
    edges = spark.createDataFrame([(1, 2, 0, [5, 6], ["footway", "steps"], ["30", "50"], 100.0, None), (2, 1, 0, [5], ["residential"], ["30 mph"], 100.0, line((100, 0), (0, 0)))], f"u long, v long, key int, osmid array<long>, highway array<string>, maxspeed array<string>, length double, geometry {LINE}")
    nodes, done = streets.street_layers(edges, vertices, "driving")
    assert tuple(done.columns) == streets.EDGE_LAYER and {r["node_id"] for r in nodes.collect()} == {"1", "2"}
    rows = {(r["from_node"], r["edge_id"]): r for r in done.collect()}
    assert set(rows) == {("1", "5"), ("1", "6"), ("2", "5")}
    first, back = rows["1", "5"], rows["2", "5"]
    assert (first["highway"], first["hwy_raw"], first["maxspeed"], first["spd_raw"]) == ("footway", "footway;steps", 50.0, "30;50")
    assert math.isclose(first["tts"], 100 / (50 / 3.6) + 4) and math.isclose(back["tts"], 100 / (30 * 1.60934 / 3.6))


def test_tags(rows):
    df = rows("h string, s string", ("cycleway;steps", "25;65"), ("track", "15 mph"), (" ;; ", " "), (None, None), ("trunk", "signals"))
    out = [tuple(r) for r in df.select(tags.road_class(F.col("h")), F.round(tags.speed_kmh(F.col("s")), 2)).collect()]
    assert [o[0] for o in out[2:]] == [None, None, "trunk"] and [o[1] for o in out] == [65.0, round(15 * 1.60934, 2), None, None, None]
    assert out[0][0] == ("footway" if {"cycleway", "steps"} & set(tags.WALKABLE) else "cycleway")
    minutes = df.select(tags.travel_minutes(F.lit(1200), 6.0)).first()[0]
    assert math.isclose(minutes, 12.0)
    with pytest.raises(ValueError):
        tags.travel_minutes(F.lit(1), 0.0)
    with pytest.raises(ValueError):
        tags.travel_seconds("gliding", *[F.lit(1)] * 5)


def test_tag_filters_against_regular_expressions(rows):
    keys, values, clauses = ["surface", "bridge"], [None, "mud", "Wood", "wooden", "ye"], []
    for k, op, v in itertools.product(keys, ["", "=", "!=", "~", "!~"], ["wood", "^mu|e$"]):
        clauses.append((k, op, v))

    def fits(own, k, op, v):
        t = own.get(k)
        if op == "":
            return t is not None
        if op in ("=", "!="):
            return (t == v) == (op == "=")
        hit = t is not None and re.search(v, t) is not None
        return hit == (op == "~")

    bags = [{k: v for k, v in zip(keys, pair) if v is not None} for pair in itertools.product(values, values)]
    df = rows("i int, tags map<string,string>", *enumerate(bags))
    asked = list(dict.fromkeys((f'["{k}"{op}"{v}"]' if op else f'["{k}"]', (k, op, v)) for k, op, v in clauses))
    found = df.select("i", *[tags.tags_match(F.col("tags"), tags.parse_filter(t)).alias(f"c{j}") for j, (t, _) in enumerate(asked)]).orderBy("i").collect()
    for bag, row in zip(bags, found):
        assert [row[f"c{j}"] for j in range(len(asked))] == [fits(bag, *c) for _, c in asked], bag
    assert all(tags.parse_filter(t) is None for t in ("no brackets", '["k"~"v",i]', '["k"]["', "[k=v]"))


def test_names_and_codes(rows):
    df = rows("n string", ("Brénol-Óstia/Ñumbra",), ("  Vall   Grån ",), ("",), (None,))
    out = [tuple(r) for r in df.select(text.normal_name(F.col("n")), text.slug(F.col("n")), text.name_parts(F.col("n"))).collect()]
    assert out[0] == ("brenol ostia numbra", "brenol_ostia_numbra", ["brenol ostia numbra", "brenol ostia", "numbra"]) and out[1][0] == "vall gran" and out[2][1] == out[3][1] == "area"
    assert [text.plain_name(r[0] or "") for r in df.collect()] == [o[0] or "" for o in out]
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("kolm") for _ in range(rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(300)]

    def swaps(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    found = rows("a string, b string", *pairs).select("a", "b", text.typo_distance(F.col("a"), F.col("b")).alias("d"), text.typo_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r["d"] == swaps(r["a"], r["b"]) and math.isclose(r["s"], 1 - r["d"] / max(len(r["a"]), len(r["b"]), 1)) for r in found)
    codes = rows("c string", ("34071919303",), ("19303",), ("34889977001",), ("--",), (None,))
    assert [tuple(r) for r in codes.select(text.province_of(F.col("c")), text.municipality_code(F.col("c"))).collect()] == [(19, "19303"), (19, "19303"), (None, "77001"), (None, None), (None, None)]
    assert [text.province_code(p) for p in (" 9 ", "BIZKAIA", "la coruna", 52, "Lérida")] == [9, 48, 15, 52, 25]
    for bad in ("0", 53, "Atlantis"):
        with pytest.raises(ValueError):
            text.province_code(bad)


TOWNS = {"Brumal/Brumalia": "34050505021", "Puente Grís de Arriba": "34060606033", "Puentegris": "34060606034", "Orvallo": "34070707011", "Orvallo ": "34080808012", "Costaluz Norte": "34090909044", "Costaluz Sur": "34090909045", "Tremedal": "34101010066"}


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(n, c, "Municipio") for n, c in TOWNS.items()] + [("Brumal", "34050500000", "Provincia")], "nameunit string, natcode string, natlevname string")


def test_area_matching(places):
    for typed, (town, step) in {"brumalia": ("Brumal/Brumalia", "part"), "BRUMAL": ("Brumal/Brumalia", "exact"), "puente gris": ("Puente Grís de Arriba", "words"), "ntegri": ("Puentegris", "substring"), "tremedla": ("Tremedal", "fuzzy"), "costaluz nrote": ("Costaluz Norte", "fuzzy")}.items():
        row, how = areas.find_area(places, typed)
        assert (row["natcode"], how) == (TOWNS[town], step), typed
    for typed, n in {"Orvallo": 2, "luz": 2}.items():
        with pytest.raises(areas.AmbiguousAreaError) as e:
            areas.find_area(places, typed)
        assert len(e.value.candidates) == n
    assert areas.find_area(places, "Orvallo", province=7)[0]["natcode"] == "34070707011" and areas.find_area(places, "Orvallo", province="Barcelona")[0]["natcode"] == "34080808012"
    assert areas.find_area(places, area_code="10066")[0]["nameunit"] == "Tremedal" and areas.find_area(places, area_code="34101010066")[1] == "code"
    for bad in (dict(name="Zzyzx"), dict(area_code="00001"), dict(name="Tremedal", province=1), dict(name="x", province="Mordor")):
        with pytest.raises(ValueError):
            areas.find_area(places, **bad)


def test_cascade_against_all_pairs(spark, places):
    """Every name with every entry, as the cascade's rules say; no step of the operator does that."""
    rng = random.Random(4)
    typed = {n for t in TOWNS for n in (t, t[:4], t[2:8], t.split("/")[-1], t.lower(), t[:3] + t[4:])} | {"".join(rng.choice("aeourvlp ") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"gris", "de arriba", "Norte"}
    listed = [(text.plain_name(n), [text.plain_name(n), *[p for p in dict.fromkeys(map(text.plain_name, n.split("/"))) if p and p != text.plain_name(n)]], c) for n, c in TOWNS.items()]
    want = {}
    for raw in typed:
        t, best = text.plain_name(raw), {}
        for w, parts, code in listed if t else ():
            step = 1 if t == w or parts[1:2] == [t] else 2 if t in parts else 3 if f" {t} " in f" {w} " else 4 if t in w else None
            if step:
                best.setdefault(step, set()).add(code)
        if t and not best:
            scored = [(1 - text.swap_distance(t, p, 99) / max(len(t), len(p)), code) for _, parts, code in listed for p in parts if text.swap_distance(t, p, 99) <= max(2, round(0.3 * max(len(t), len(p))))]
            top = max((s for s, _ in scored if s >= 0.8), default=None)
            if top is not None:
                best[5] = {c for s, c in scored if s > top - 1e-9}
        if best:
            k = min(best)
            want[raw] = (k, len(best[k]), next(iter(best[k])) if len(best[k]) == 1 else None)
    names = spark.createDataFrame([(t,) for t in [*typed, None]], "area_name string")
    made = areas.match_cascade(names, places.where("natlevname = 'Municipio'"))
    assert {r["area_name"]: (r["step"], r["n_codes"], r["code"]) for r in made.collect()} == want and {k for k, *_ in want.values()} == {1, 2, 3, 4, 5}
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in made._jdf.queryExecution().executedPlan().toString()
    assert areas.match_cascade(names.limit(0), places).count() == 0


def test_overlaps(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    notch = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    assert math.isclose(areas.overlap_area([square], [notch]), areas.overlap_area([notch], [notch])) and math.isclose(areas.overlap_area([notch], [notch]), 16 - 6)
    hole = [square, [(1, 1), (3, 1), (3, 3), (1, 3)]]
    assert math.isclose(areas.overlap_area(hole, [square]), 12) and areas.overlap_area([square], [[(9, 9), (10, 9), (10, 10)]]) == 0
    assert math.isclose(areas.overlap_area([square], [[(2, -2), (6, 2), (2, 6), (-2, 2)]]), 16.0)
    make = lambda data: spark.createDataFrame([(i, [line(*r)]) for i, r in data], f"id int, rings array<{LINE}>")
    shared = areas.overlaps(make([(1, square)]), make([(10, [(0, 0), (2, 0), (2, 4), (0, 4)]), (11, [(2, 0), (5, 0), (5, 4), (2, 4)]), (12, [(3.9, 0), (60, 0), (60, 4), (3.9, 4)]), (13, [(70, 0), (71, 0), (71, 1)])]), 3.0)
    assert sorted((r["region_id"], round(r["shared"], 6)) for r in shared.collect()) == [(10, 8.0), (11, 8.0), (12, 0.4)]
    assert {r["region_id"] for r in areas.municipalities_in(shared).collect()} == {10, 11}
    assert [(r["province"], r["share"]) for r in areas.province_shares(shared, F.col("region_id") % 2).collect()] == [(0, 0.525), (1, 0.5)]
    assert len(areas.convex_hull(np.array([(0, 0), (1, 1), (2, 0), (2, 2), (0, 2)]))) == 4
    ring = areas.capsule(0, 0, 10, 0, 1, 64)
    assert math.isclose(areas.overlap_area([ring], [ring]), 20 + math.pi, rel_tol=1e-3)


def test_predicates_and_projections(rows):
    area = [[[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]]]
    pts = rows("x double, y double", (1.0, 1.0), (5.0, 5.0), (4.0, 5.0), (0.0, 3.0), (11.0, 1.0))
    assert [r[0] for r in pts.select(geo.point_inside(F.col("x"), F.col("y"), area)).collect()] == [True, False, True, True, False]
    assert [r[0] for r in pts.select(geo.distance_to(F.col("x"), F.col("y"), area)).collect()] == [0.0, 1.0, 0.0, 0.0, 1.0]
    seg = rows("a double, b double, c double, d double", (-5.0, 5.0, 15.0, 5.0), (4.5, 4.5, 5.5, 5.5), (-1.0, -1.0, -2.0, 5.0), (-1.0, 1.0, 1.0, -1.0))
    assert [r[0] for r in seg.select(geo.segment_meets(*map(F.col, "abcd"), area)).collect()] == [True, False, False, True]
    places = rows("lon double, lat double", (-0.3763, 39.4699), (-3.7, 40.4))
    for epsg in (25830, 32630):
        x, y = proj.to_utm(F.col("lon"), F.col("lat"), epsg)
        got = places.select("lon", "lat", x.alias("x"), y.alias("y"))
        lon, lat = proj.from_utm(F.col("x"), F.col("y"), epsg)
        for r in got.select("lon", "lat", lon.alias("o"), lat.alias("a"), "x", "y").collect():
            assert abs(r["lon"] - r["o"]) < 1e-9 and abs(r["lat"] - r["a"]) < 1e-9
    r = places.select(*proj.to_utm(F.lit(-3.0), F.lit(0.0), 32630)).first()
    assert abs(r[0] - 500000) < 1e-6 and abs(r[1]) < 1e-6
    r = places.select(*proj.to_equal_area(F.lit(10.0), F.lit(52.0)), *proj.to_mercator(F.lit(180.0), F.lit(0.0))).first()
    assert abs(r[0] - 4321000) < 1e-3 and abs(r[1] - 3210000) < 1e-3 and abs(r[2] - 20037508.342789244) < 1e-6 and abs(r[3]) < 1e-6
    assert proj.utm_zone(-0.4, 39) == 32630 and proj.utm_zone(-70, -33) == 32719


def test_sources_and_sinks(spark, rows, tmp_path):
    answer = {"elements": [{"type": "node", "id": i, "lat": 0.0, "lon": float(i)} for i in range(4)] + [{"type": "way", "id": 9, "nodes": [0, 1], "tags": {"highway": "motorway"}}, {"type": "way", "id": 8, "nodes": [2, 3], "tags": {"highway": "path"}}]}
    (tmp_path / "a.json").write_text(json.dumps(answer))
    made = street_networks(read_elements(spark, str(tmp_path / "a.json")), {"driving": '["highway"="motorway"]', "walking": '["highway"!="motorway"]'})
    assert {r["id"] for r in made["driving"][1].collect()} == {0, 1} and {r["id"] for r in made["walking"][0].collect()} == {8}
    with pytest.raises(ValueError):
        street_networks(made["driving"][0], {"x": "nonsense"})
    shape = {"type": "FeatureCollection", "features": [{"properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"properties": {"n": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(shape))
    assert [len(r["rings"]) for r in read_geojson(spark, str(tmp_path / "g.json")).collect()] == [1, 2]
    nodes = rows("node_id string, x double, y double", ("a", 0.0, float("nan")))
    edges = spark.createDataFrame([("a", "b", 1.0, ["p", "q"], line((0, 0), (3, 4)))], f"from_node string, to_node string, tts double, tags array<string>, geometry {LINE}")
    node_link(nodes, edges, tmp_path / "graph.json", "EPSG:25830")
    data = json.loads((tmp_path / "graph.json").read_text())
    assert data["edges"][0]["tags"] == "p; q" and data["edges"][0]["geometry"].startswith("LINESTRING (0.0 0.0, 3.0") and {n["id"] for n in data["nodes"]} == {"a", "b"}
    back_nodes, back_edges = read_graph(spark, str(tmp_path / "graph.json"))
    assert back_edges.first()["to_node"] == "b" and back_nodes.count() == 2
    collection(geojson_lines(edges), tmp_path / "c.geojson")
    assert json.loads((tmp_path / "c.geojson").read_text())["features"][0]["geometry"]["coordinates"] == [[0.0, 0.0], [3.0, 4.0]]
    assert len(write_layers({"e": edges, "none": edges.limit(0)}, tmp_path / "out")) == 1
    write_schedule(rows("trip string, n int", ("t", 1)), tmp_path / "s.gpkg")
    write_report(spark, [{"source": "user", "status": "written"}], tmp_path / "r.csv")
    assert (tmp_path / "r.csv").read_text().splitlines()[0] == ",".join(report.REPORT_COLUMNS)


def test_retries_and_catalogue(spark, tmp_path):
    tried, waited = [], []

    def action():
        tried.append(1)
        if len(tried) < 3:
            raise TemporaryFailure("busy")
        return "done"

    assert with_retries(action, sleep=waited.append) == "done" and waited == [10, 20]
    schema = "province_code int, dataset_id long, dataset_name string, types array<struct<id: int, name: string>>, files array<struct<id: long, name: string>>"
    cat = spark.createDataFrame([(46, 1, "a", [(1, "Bus")], [(10, "a.zip"), (11, "b.zip")]), (12, 1, "a", [(1, "Bus")], [(10, "a.zip")]), (46, 2, "b", [(3, None)], [(12, "c.zip")])], schema)
    files, left = catalogue_files(cat, [12, 46], [1, 2])
    assert {(r["file_id"], r["province_code"]) for r in files.collect()} == {(10, 12), (11, 46)} and [r["transport_types"] for r in left.collect()] == ["3"]

    def fetch(f):
        if f["file_id"] == 11:
            raise OSError("gone")
        return b"zip"

    rows_ = fetch_files([r.asDict() for r in files.orderBy("file_id").collect()], tmp_path / "z", fetch)
    assert [(r["status"], r["error"]) for r in rows_] == [("downloaded", None), ("failed", "gone")]


def blocks(spark, n=7, gap=3):
    """A grid of one-way streets (every third one both ways) over two areas with a strip between them."""
    at = lambda i, j: i * 100 + j
    vertices = [(at(i, j), 50.0 * i, 40.0 * j, None) for i in range(2 * n + gap) for j in range(n)]
    edges = []
    for i, j in itertools.product(range(2 * n + gap), range(n)):
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < 2 * n + gap and v < n:
                a, b = (at(i, j), at(u, v)) if (i + j) % 2 else (at(u, v), at(i, j))
                edges.append((a, b, 0, 50.0 if v == j else 40.0))
                if (i + j) % 3 == 0:
                    edges.append((b, a, 0, 50.0 if v == j else 40.0))
    made = spark.createDataFrame([(a, b, k, a * 1000 + b, "residential", x, None) for a, b, k, x in edges], f"u long, v long, key int, osmid long, highway string, length double, geometry {LINE}")
    area = [[[(-10, -10), (50 * (n - 1) + 10, -10), (50 * (n - 1) + 10, 400), (-10, 400)]], [[(50 * (n + gap) - 10, -10), (50 * (2 * n + gap - 3) + 10, -10), (50 * (2 * n + gap - 3) + 10, 400), (50 * (n + gap) - 10, 400)]]]
    return spark.createDataFrame(vertices, "node_id long, x double, y double, highway string"), made, area, edges


def test_streets_of_an_area_with_two_parts(spark):
    vertices, edges, area, listed = blocks(spark)
    assert [p[0][0] for p in streets.parts_by_size(area[::-1])] == [area[0][0][0], area[1][0][0]]
    place = {r["node_id"]: (r["x"], r["y"]) for r in vertices.collect()}
    part = {v: k for v, (x, y) in place.items() for k, a in enumerate(area, 1) if a[0][0][0] <= x <= a[0][1][0]}
    kept, done, lost = streets.area_streets(vertices, edges, area)
    rows = done.collect()
    own = {(r["u"], r["v"]) for r in rows if not r["connector"]}
    assert own == {(a, b) for a, b, *_ in listed if a in part or b in part} and lost == []
    out = {}
    for r in rows:
        out.setdefault(r["u"], set()).add(r["v"])

    def reached(start):
        seen, todo = {start}, [start]
        while todo:
            for w in out.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return {part.get(v) for v in seen}

    assert any(2 in reached(v) for v in place if part.get(v) == 1) and any(1 in reached(v) for v in place if part.get(v) == 2)
    assert {r["node_id"] for r in kept.collect()} == {x for r in rows for x in (r["u"], r["v"])}
    alone = edges.join(vertices.where("x between 310 and 440").select(F.col("node_id").alias("u")), "u", "left_anti").select(*edges.columns)
    assert streets.area_streets(vertices, alone, area)[2] == [2]
    assert streets.area_streets(vertices, edges, area, connect=False)[1].count() == len([1 for a, b, *_ in listed if a in part or b in part])
    lines = streets.ends_geometry(edges, vertices)
    assert streets.clip_lines(lines, [area[0]]).count() == sum(min(place[a][0], place[b][0]) <= area[0][0][1][0] for a, b, *_ in listed)


def test_simplified_chains(spark):
    vertices = spark.createDataFrame([(i, 10.0 * i, float(i % 2), None) for i in range(12)], "node_id long, x double, y double, highway string")
    both = [(0, 1), (1, 2), (2, 3), (3, 4)]
    listed = both + [(b, a) for a, b in both] + [(4, 5), (5, 6), (6, 7), (4, 8), (8, 8), (9, 10), (10, 11), (11, 9)]
    edges = spark.createDataFrame([(a, b, 0, f"w{min(a, b)}", 10.0 + a, None) for a, b in listed], f"u long, v long, key int, osmid string, length double, geometry {LINE}")
    left, done = streets.simplified(vertices, edges)
    found = {(r["u"], r["v"]): r for r in done.collect()}
    assert set(found) == {(0, 4), (4, 0), (4, 7), (4, 8), (8, 8), (9, 10), (10, 11), (11, 9)}
    assert found[0, 4]["length"] == 46.0 and found[4, 7]["length"] == 45.0 and found[0, 4]["osmid"] == ["w0", "w1", "w2", "w3"]
    assert [p["x"] for p in found[4, 0]["geometry"]] == [40.0, 30.0, 20.0, 10.0, 0.0] and {r["node_id"] for r in left.collect()} == {0, 4, 7, 8, 9, 10, 11}


def test_a_whole_network_is_built_and_searched(spark, tmp_path):
    from railweave import api

    vertices, edges, area, _ = blocks(spark)
    feed = tmp_path / "shuttle"
    feed.mkdir()
    for name, lines in {
        "stops": ["stop_id,stop_name,stop_lon,stop_lat", "m,Mill,30,30", "n,Nook,90,80", "o,Oak,240,60"],
        "routes": ["route_id,route_short_name,route_type", "s,Sh,3"],
        "trips": ["route_id,service_id,trip_id", "s,all,a", "s,all,b"],
        "stop_times": ["trip_id,stop_sequence,stop_id,departure_time,arrival_time", *[f"{t},{k},{s},{h}:{m}:00,{h}:{m}:00" for t, h in (("a", "07"), ("b", "12")) for k, (s, m) in enumerate((("m", "00"), ("n", "04"), ("o", "11")))]],
        "calendar": ["service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date", "all,1,1,1,1,1,1,1,20310101,20311231"],
    }.items():
        (feed / f"{name}.txt").write_text("\n".join(lines))
    (tmp_path / "broken").mkdir()
    cat = spark.createDataFrame([(8, 5, "set", [(1, "Bus")], [(77, "gone.zip")]), (8, 6, "rails", [(3, "Rail")], [(78, "r.zip")])], "province_code int, dataset_id bigint, dataset_name string, types array<struct<id: int, name: string>>, files array<struct<id: bigint, name: string>>")

    def fetch(f):
        raise OSError("unplugged")

    made = api.build_network(spark, tmp_path / "out", modes=["walk", "bus"], streets={"walking": (vertices, edges)}, feeds={"shuttle": str(feed), "broken": str(tmp_path / "broken")}, catalogue=cat, provinces=["Barcelona"], fetch=fetch, area=area, simplify=True, schedule=True)
    status = {(r["source"], r.get("file_name") or r.get("dataset_name")): r["status"] for r in made["report"]}
    assert status == {("user", "shuttle"): "written", ("user", "broken"): "failed_processing", ("catalogue", "gone.zip"): "failed", ("catalogue", "rails"): "not_requested_type"}
    bus = api.shortest_path(tmp_path / "out" / "bus" / "shuttle", "m", ["o", "n"], None, weight="tts_m", mode="bus", geometry=False, spark=spark).collect()
    assert [(r["destination"], r["n_edges"]) for r in bus] == [("o", 2), ("n", 1)]
    assert json.loads((tmp_path / "out" / "bus" / "shuttle" / "graph.json").read_text())["directed"] is True
    own = api.load_network(spark, tmp_path / "out", "walking")
    assert own.n_edges() > 50 and made["unconnected_parts"] == {"walking": []}
    late = api.build_network(spark, tmp_path / "late", modes="bus", feeds=[("x", str(feed))], date="2035-01-01")
    assert late["report"][0]["status"] == "no_service_on_date" and "runs from 2031-01-01" in late["report"][0]["error"]
