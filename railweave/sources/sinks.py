"""Writers: layers as Parquet and GeoJSON, schedules as CSV or a database table, graphs as node-link JSON, reports."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.functions.geo import wkt_line
from railweave.operators.report import REPORT_COLUMNS


def flat(df: DataFrame) -> DataFrame:
    """``df`` with lists of scalars as ``a; b``, other nested values as JSON, and NaN as null."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array<") and not kind.startswith(("array<struct", "array<array", "array<map")):
            c = F.array_join(c.cast("array<string>"), "; ")
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(name))
    return df.select(*out)


def _geometry(df: DataFrame) -> Column:
    if "geometry" in df.columns:
        line = F.transform("geometry", lambda p: F.array(p["x"], p["y"]))
        return F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))
    return F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))


def geojson_lines(df: DataFrame) -> DataFrame:
    """One JSON feature per row in a column ``value``: the form that readers of line-delimited GeoJSON take."""
    properties = [c for c in df.columns if c not in ("geometry", "x", "y", "_ordinal")]
    own = flat(df.select(*properties)) if properties else None
    names = own.columns if own is not None else []
    kept = df.select(*[F.col(f"`{c}`") for c in properties], _geometry(df).alias("_g"))
    flat_kept = flat(kept.select(*properties)).columns if properties else []
    assert names == flat_kept
    columns = [(F.array_join(F.col(f"`{n}`").cast("array<string>"), "; ") if t.startswith("array<") and not t.startswith(("array<struct", "array<array")) else F.to_json(F.col(f"`{n}`")) if t.startswith(("array", "struct", "map")) else F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) if t in ("double", "float") else F.col(f"`{n}`")).alias(n) for n, t in kept.dtypes if n != "_g"]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*columns).alias("properties") if columns else F.lit("{}").alias("properties"), F.col("_g").alias("geometry"))
    return kept.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_layers(layers: Mapping[str, DataFrame], folder: str | Path, form: str = "parquet") -> list[str]:
    """Each layer that isn't empty, as ``folder/name.parquet`` (partitioned) or ``.geojsonl`` (a folder of text parts);
    ``shp`` writes a shapefile a layer, ``gpkg`` one GeoPackage of all layers, both on the driver."""
    from railweave.sources.shapes import write_geopackage, write_shapefile

    if form == "gpkg":
        return [str(write_geopackage(layers, f"{folder}/layers.gpkg"))]
    written = []
    for name, df in layers.items():
        if df.isEmpty():
            continue
        target = f"{folder}/{name}.{'geojsonl' if form == 'geojson' else form}"
        if form == "parquet":
            df.write.mode("overwrite").parquet(target)
        elif form == "geojson":
            geojson_lines(df).write.mode("overwrite").text(target)
        elif form == "csv":
            flat(df).write.mode("overwrite").option("header", True).csv(target)
        elif form == "shp":
            write_shapefile(df, target)
        else:
            raise ValueError(f"layers can be written as parquet, geojson, csv, shp or gpkg, not {form!r}")
        written.append(target)
    return written


def collection(features: DataFrame, path: str | Path) -> Path:
    """One ``FeatureCollection`` file, streamed through the driver a partition at a time: for exports of moderate size."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        out.write('{"type": "FeatureCollection", "features": [')
        for i, row in enumerate(features.toLocalIterator()):
            out.write((",\n" if i else "\n") + row["value"])
        out.write("\n]}\n")
    return target


def node_link(nodes: DataFrame, edges: DataFrame, path: str | Path, crs: str | None = None, edge_columns: Sequence[str] | None = None) -> Path:
    """A node-link graph file; lines are WKT, an end that no node has gets the place of the edge's end."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    columns = [c for c in (edge_columns or edges.columns) if c in edges.columns and c not in ("geometry", "_ordinal")]
    shown = edges.select("from_node", "to_node", *[c for c in columns if c not in ("from_node", "to_node")], *([wkt_line(F.col("geometry")).alias("geometry")] if "geometry" in edges.columns else []))
    text = lambda df: F.to_json(F.struct(*[F.col(f"`{c}`") for c in flat(df).columns]), {"ignoreNullFields": "false"})
    own = flat(nodes.drop("_ordinal").withColumnRenamed("node_id", "id"))
    if "geometry" in edges.columns:
        place = lambda c, k: edges.select(F.col(c).alias("id"), F.element_at("geometry", k)["x"].alias("x"), F.element_at("geometry", k)["y"].alias("y"))
        ends = place("from_node", 1).unionByName(place("to_node", -1)).where(F.col("id").isNotNull())
        lost = ends.join(own.select("id"), "id", "left_anti").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
        own = own.unionByName(lost, allowMissingColumns=True)
    ids = {"source": "from_node", "target": "to_node"}
    linked = flat(shown.withColumnsRenamed({v: k for k, v in ids.items()})).withColumn("key", F.lit(0))
    with target.open("w", encoding="utf-8") as out:
        out.write(json.dumps({"directed": True, "multigraph": True, "graph": {"crs": crs}})[:-1])
        for name, df in (("nodes", own), ("edges", linked)):
            out.write(f', "{name}": [')
            for i, row in enumerate(df.select(text(df).alias("v")).toLocalIterator()):
                out.write((",\n" if i else "\n") + row["v"])
            out.write("\n]")
        out.write("}\n")
    return target


def write_schedule(schedule: DataFrame, path: str | Path) -> Path:
    """A schedule as a plain table of a SQLite database (``.gpkg``, ``.sqlite``), streamed, or as a CSV folder."""
    target = Path(path)
    if target.suffix not in (".gpkg", ".sqlite"):
        flat(schedule).write.mode("overwrite").option("header", True).csv(str(target))
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    rows = flat(schedule)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL"}
    with sqlite3.connect(target) as db:
        db.execute("drop table if exists schedule")
        db.execute("create table schedule (" + ", ".join(f'"{n}" {kinds.get(t, "TEXT")}' for n, t in rows.dtypes) + ")")
        marks = ", ".join("?" * len(rows.columns))
        db.executemany(f"insert into schedule values ({marks})", (tuple(r) for r in rows.toLocalIterator()))
    return target


def write_report(spark, rows: Sequence[Mapping], path: str | Path) -> Path:
    """Report rows as CSV with the report's columns in order."""
    import csv

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8", newline="") as out:
        writer = csv.DictWriter(out, REPORT_COLUMNS, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)
    return target
