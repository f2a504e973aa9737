import sqlite3
import struct

import pytest

from railweave.sources.shapes import read_boundaries, rings_of_wkb, to_wkb, write_geopackage, write_shapefile
from railweave.sources.sinks import write_layers

LINE = "array<struct<x: double, y: double>>"


def polygons(path):
    """A GeoPackage of two polygon rows, made by hand; one has a box before its shape."""
    ring, hole = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)], [(5.0, 1.0), (6.0, 1.0), (6.0, 2.0), (5.0, 1.0)]
    with sqlite3.connect(path) as db:
        db.executescript("create table gpkg_contents (table_name, data_type); create table gpkg_geometry_columns (table_name, column_name, geometry_type_name); create table lands (id integer, shape blob, label text);")
        db.execute("insert into gpkg_contents values ('lands', 'features')")
        db.execute("insert into gpkg_geometry_columns values ('lands', 'shape', 'MULTIPOLYGON')")
        many = struct.pack("<BII", 1, 6, 2) + to_wkb("Polygon", [ring, hole]) + to_wkb("Polygon", [ring])
        for i, (flags, box, body) in enumerate([(1, b"", to_wkb("Polygon", [ring])), (3, struct.pack("<4d", 0, 9, 0, 9), many)]):
            db.execute("insert into lands values (?, ?, ?)", (i, b"GP\x00" + bytes([flags]) + struct.pack("<i", 25830) + box + body, f"land {i}"))
        db.execute("insert into lands values (9, null, 'nowhere')")
    return path


def test_geopackages(spark, tmp_path):
    found = read_boundaries(spark, polygons(tmp_path / "a.gpkg")).collect()
    assert [(r["properties"]["label"], r["kind"], len(r["rings"])) for r in found] == [("land 0", "Polygon", 1), ("land 1", "MultiPolygon", 3)] and found[1]["rings"][1][1]["x"] == 6.0
    stops = spark.createDataFrame([("s1", 1.5, 2.5, float("nan"), ["a", "b"]), ("s2", None, None, 3.0, None)], "node_id string, x double, y double, load double, tags array<string>")
    ways = spark.createDataFrame([("w", [(0.0, 1.0), (2.0, 3.0)])], f"edge_id string, geometry {LINE}")
    path = write_geopackage({"stops": stops, "ways": ways, "none": ways.limit(0)}, tmp_path / "out" / "b.gpkg")
    with sqlite3.connect(path) as db:
        assert db.execute("select table_name, geometry_type_name from gpkg_geometry_columns order by 1").fetchall() == [("stops", "POINT"), ("ways", "LINESTRING")]
        rows = db.execute("select geom, node_id, load, tags from stops order by fid").fetchall()
        assert rows[0][1:] == ("s1", None, "a; b") and rows[0][0][8:] == to_wkb("Point", (1.5, 2.5)) and rows[1][0] is None
    assert rings_of_wkb(to_wkb("LineString", [(0, 0), (1, 1)])) == ("LineString", [])


def test_shapefiles(spark, tmp_path):
    ways = spark.createDataFrame([("wé", 7, [(0.0, 1.0), (2.0, 3.0), (5.0, 5.0)]), ("none", None, None)], f"a_rather_long_name string, n long, geometry {LINE}")
    path = write_shapefile(ways, tmp_path / "w.shp")
    data = path.read_bytes()
    assert struct.unpack(">i", data[:4])[0] == 9994 and struct.unpack(">i", data[24:28])[0] * 2 == len(data) and struct.unpack("<i", data[108:112])[0] == 3
    assert struct.unpack("<6d", data[160:208]) == (0.0, 1.0, 2.0, 3.0, 5.0, 5.0) or struct.unpack("<6d", data[156:204]) == (0.0, 1.0, 2.0, 3.0, 5.0, 5.0)
    # polygons: the same file with its kind turned from line to polygon has one ring
    raw = bytearray(data)
    raw[32:36] = raw[108:112] = struct.pack("<i", 5)
    path.write_bytes(bytes(raw))
    found = read_boundaries(spark, path).collect()
    assert len(found) == 1 and found[0]["properties"] == {"a_rather_l": "wé", "n": "7"} and [(p["x"], p["y"]) for p in found[0]["rings"][0]] == [(0.0, 1.0), (2.0, 3.0), (5.0, 5.0)]
    assert len(write_layers({"ways": ways}, tmp_path / "o", "shp")) == 1 and len(write_layers({"ways": ways}, tmp_path / "o", "gpkg")) == 1
    for bad in ("x.txt", "x.kml"):
        with pytest.raises(ValueError):
            read_boundaries(spark, tmp_path / bad)
