"""Shapefiles and GeoPackages: layers of moderate size, written and read on the driver a row at a time."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.sources.sinks import flat

#: Geometry codes of well-known binary and of shapefiles.
WKB = {1: "Point", 2: "LineString", 3: "Polygon", 6: "MultiPolygon"}
SHP_POINT, SHP_LINE, SHP_POLYGON = 1, 3, 5
RINGS = "properties map<string,string>, kind string, rings array<array<struct<x:double,y:double>>>"


def to_wkb(kind: str, points) -> bytes:
    """A point ``(x, y)``, a line of points or a polygon's rings in little-endian well-known binary."""
    code = {v: k for k, v in WKB.items()}[kind]
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<2d", *p) for p in ps)
    head = struct.pack("<BI", 1, code)
    if kind == "Point":
        return head + struct.pack("<2d", *points)
    return head + (line(points) if kind == "LineString" else struct.pack("<I", len(points)) + b"".join(map(line, points)))


def rings_of_wkb(data: bytes) -> tuple[str, list]:
    """``(kind, rings)`` of a polygon or multipolygon; other kinds have no rings.  Heights and measures are passed over."""

    def shape(at: int) -> tuple[str, list, int]:
        end = "<" if data[at] == 1 else ">"
        code = struct.unpack_from(f"{end}I", data, at + 1)[0]
        at += 5
        # heights and measures are told by the top bits or by thousands
        width = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + {1: 1, 2: 1, 3: 2}.get((code & 0xFFFF) // 1000, 0)
        kind = WKB.get(code & 0xFF if code & 0xE0000000 else code % 1000, "other")
        if code & 0x20000000:
            at += 4
        rings: list = []
        if kind in ("Polygon", "MultiPolygon"):
            n = struct.unpack_from(f"{end}I", data, at)[0]
            at += 4
            for _ in range(n):
                if kind == "MultiPolygon":
                    _, more, at = shape(at)
                    rings += more
                    continue
                m = struct.unpack_from(f"{end}I", data, at)[0]
                flat_ = struct.unpack_from(f"{end}{m * width}d", data, at + 4)
                rings.append([(flat_[i], flat_[i + 1]) for i in range(0, m * width, width)])
                at += 4 + 8 * m * width
        return kind, rings, at

    kind, rings, _ = shape(0)
    return kind, rings


def _rows(df: DataFrame) -> tuple[list[tuple[str, str]], str, Iterator]:
    """The plain columns, the geometry's kind and the rows with ``(values, points)``."""
    kind = "LineString" if "geometry" in df.columns else "Point"
    names = [c for c in df.columns if c not in ("geometry", "x", "y", "_ordinal")]
    plain = flat(df.select(*names))
    place = F.transform("geometry", lambda p: F.array(p["x"], p["y"])) if kind == "LineString" else F.array("x", "y")
    values = df.select(*[_one(df, c) for c in names], place.alias("_place"))
    return plain.dtypes, kind, ((tuple(r)[:-1], r["_place"]) for r in values.toLocalIterator())


def _one(df: DataFrame, name: str):
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind.startswith("array<") and not kind.startswith(("array<struct", "array<array", "array<map")):
        return F.array_join(c.cast("array<string>"), "; ").alias(name)
    return (F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.when(~F.isnan(c), c) if kind in ("double", "float") else c).alias(name)


_SQL_KIND = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "BOOLEAN", "double": "REAL"}


def write_geopackage(layers: Mapping[str, DataFrame], path: str | Path, srs: int = 25830) -> Path:
    """Point and line layers as one GeoPackage; empty layers are left out, rows without a place have no geometry."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.unlink(missing_ok=True)
    with sqlite3.connect(target) as db:
        db.executescript(
            """pragma application_id = 1196444487; pragma user_version = 10300;
            create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
            create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change text default current_timestamp, min_x double, min_y double, max_x double, max_y double, srs_id integer);
            create table gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null);"""
        )
        db.executemany("insert into gpkg_spatial_ref_sys values (?, ?, ?, ?, 'undefined', null)", [(f"EPSG:{srs}", srs, "EPSG", srs), ("undefined", -1, "NONE", -1), ("undefined geographic", 0, "NONE", 0)])
        for name, df in layers.items():
            if df.isEmpty():
                continue
            columns, kind, rows = _rows(df)
            db.execute(f'create table "{name}" (fid integer primary key autoincrement, geom blob' + "".join(f', "{n}" {_SQL_KIND.get(t, "TEXT")}' for n, t in columns) + ")")
            head = b"GP\x00\x01" + struct.pack("<i", srs)
            known = lambda p: p and None not in p and all(v is not None for v in p)
            blob = lambda p: head + to_wkb(kind, p) if known(p) else None  # noqa: B023, E731
            db.executemany(f'insert into "{name}" (geom' + "".join(f', "{n}"' for n, _ in columns) + f") values (?{', ?' * len(columns)})", ((blob(p), *v) for v, p in rows))
            db.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (name, name, srs))
            db.execute("insert into gpkg_geometry_columns values (?, 'geom', ?, ?, 0, 0)", (name, kind.upper(), srs))
    return target


def read_geopackage(spark: SparkSession, path: str | Path) -> DataFrame:
    """``(properties, kind, rings)`` of the polygons of a GeoPackage's only (polygon) layer."""
    from railweave.sources.streets import polygon_layer

    layer = polygon_layer(path)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        geom = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()[0]
        found = db.execute(f'select * from "{layer}"')
        names = [c[0] for c in found.description]
        out = []
        for row in found:
            values = dict(zip(names, row))
            blob = values.pop(geom)
            if blob is None:
                continue
            body = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
            kind, rings = rings_of_wkb(blob[body:])
            out.append(({k: None if v is None else str(v) for k, v in values.items()}, kind, rings))
    return spark.createDataFrame(out, RINGS)


def _dbf(rows: list[tuple], columns: list[tuple[str, str]]) -> bytes:
    """An attribute table: texts of at most 254 bytes, names of at most ten characters."""
    text = [["" if v is None else str(v).encode("utf-8")[:254].decode("utf-8", "ignore") for v in r] for r in rows]
    sizes = [max([1, *(len(r[i].encode()) for r in text)]) for i in range(len(columns))]
    numeric = [t in ("bigint", "int", "double", "float") for _, t in columns]
    head = struct.pack("<BBBBIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(columns), 1 + sum(sizes))
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], b"N" if num else b"C", size, 15 if num and t in ("double", "float") and size > 17 else 0) for (n, t), size, num in zip(columns, sizes, numeric))
    pad = lambda v, size, num: v.encode().rjust(size) if num else v.encode().ljust(size)
    return head + fields + b"\r" + b"".join(b" " + b"".join(pad(v, s, n) for v, s, n in zip(r, sizes, numeric)) for r in text) + b"\x1a"


def write_shapefile(df: DataFrame, path: str | Path) -> Path:
    """A point or line layer as ``.shp``, ``.shx`` and ``.dbf``; column names are cut to ten characters."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    columns, kind, rows = _rows(df)
    code = SHP_POINT if kind == "Point" else SHP_LINE
    values, records, all_points = [], [], []
    for v, p in rows:
        values.append(v)
        points = [p] if kind == "Point" else [tuple(q) for q in p or ()]
        if not points or any(c is None for q in points for c in q):
            records.append(struct.pack("<i", 0))
            continue
        all_points += points
        xs, ys = [q[0] for q in points], [q[1] for q in points]
        body = struct.pack("<2d", *points[0]) if kind == "Point" else struct.pack("<4d3i", min(xs), min(ys), max(xs), max(ys), 1, len(points), 0) + b"".join(struct.pack("<2d", *q) for q in points)
        records.append(struct.pack("<i", code) + body)
    xs, ys = [q[0] for q in all_points] or [0.0], [q[1] for q in all_points] or [0.0]

    def head(size: int) -> bytes:
        return struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i8d", 1000, code, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)

    at, index = 50, b""
    for r in records:
        index += struct.pack(">2i", at, len(r) // 2)
        at += 4 + len(r) // 2
    target.with_suffix(".shp").write_bytes(head(at * 2) + b"".join(struct.pack(">2i", i, len(r) // 2) + r for i, r in enumerate(records, 1)))
    target.with_suffix(".shx").write_bytes(head(100 + len(index)) + index)
    target.with_suffix(".dbf").write_bytes(_dbf(values, columns))
    target.with_suffix(".cpg").write_text("UTF-8")
    return target.with_suffix(".shp")


def read_shapefile(spark: SparkSession, path: str | Path) -> DataFrame:
    """``(properties, kind, rings)`` of a shapefile of polygons; records without a shape are left out."""
    place = Path(path)
    data, table = place.with_suffix(".shp").read_bytes(), place.with_suffix(".dbf").read_bytes()
    n, start, width = struct.unpack_from("<IHH", table, 4)
    coded = place.with_suffix(".cpg")
    encoding = coded.read_text().strip() if coded.exists() else "utf-8"
    fields = [(table[i : i + 11].split(b"\0")[0].decode(), table[i + 16]) for i in range(32, start - 1, 32)]
    out, at, k = [], 100, 0
    while at < len(data) and k < n:
        size = struct.unpack_from(">2i", data, at)[1] * 2
        if struct.unpack_from("<i", data, at + 8)[0] % 10 == SHP_POLYGON:
            parts, points = struct.unpack_from("<2i", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
            row, cell, told = table[start + k * width : start + (k + 1) * width], 1, {}
            for name, length in fields:
                told[name] = row[cell : cell + length].decode(encoding, "replace").strip() or None
                cell += length
            out.append((told, "Polygon" if parts == 1 else "MultiPolygon", rings))
        at += 8 + size
        k += 1
    return spark.createDataFrame(out, RINGS)


def read_boundaries(spark: SparkSession, path: str | Path) -> DataFrame:
    """``(properties, kind, rings)`` of a boundaries file by its ending: GeoJSON, GeoPackage or shapefile; raises ``ValueError`` for others and for none."""
    from railweave.sources.streets import read_geojson

    ending = Path(path).suffix.lower()
    if ending in (".json", ".geojson"):
        found = read_geojson(spark, str(path))
    elif ending in (".gpkg", ".shp"):
        found = (read_geopackage if ending == ".gpkg" else read_shapefile)(spark, path)
    else:
        raise ValueError(f"boundaries are read from .shp, .gpkg, .geojson and .json, not {ending!r}")
    if found.isEmpty():
        raise ValueError(f"{path} has no polygon")
    return found
