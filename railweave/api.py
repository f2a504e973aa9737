"""The functions most users need."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.functions.calendar import service_date
from railweave.operators import network as net
from railweave.functions.polygons import ring_area
from railweave.functions.text import province_code
from railweave.operators.areas import convex_hull, find_area, tiled_union
from railweave.operators.streets import area_streets, simplified, street_layers
from railweave.operators.timetable import feed_mode, no_service, normalize_feed, output_edges, output_stops
from railweave.scale import cut
from railweave.sources.shapes import read_boundaries
from railweave.sources.sinks import node_link, write_layers, write_report
from railweave.sources.streets import load_network, read_graph, read_matrix, write_matrix
from railweave.sources.timetables import catalogue_files, feed_name, fetch_files, named_feeds, read_feed, unique_name

__all__ = ["build_network", "find_area", "isochrones", "load_network", "read_boundaries", "read_graph", "read_matrix", "shortest_path"]

STREET_MODES, TRANSIT_MODES = ("walking", "bike", "driving"), ("bus", "train")
#: The catalogue's types of transport by mode (1 urban bus, 2 coach, 3 rail).
CATALOGUE_TYPES = {"bus": (1, 2), "train": (3,)}
#: Other names of modes.
SYNONYMS = {"walk": "walking", "foot": "walking", "cycling": "bike", "bicycle": "bike", "drive": "driving", "car": "driving", "rail": "train"}


def split_modes(modes: Sequence[str] | str) -> tuple[list[str], list[str]]:
    """``(street modes, transit modes)``, without blanks, case and repeats; raises ``ValueError`` for others."""
    wanted = [m.strip().lower() for m in ([modes] if isinstance(modes, str) else modes)]
    wanted = list(dict.fromkeys(SYNONYMS.get(m, m) for m in wanted))
    bad = [m for m in wanted if m not in STREET_MODES + TRANSIT_MODES]
    if bad or not wanted:
        raise ValueError(f"modes are {', '.join(STREET_MODES + TRANSIT_MODES)}, not {', '.join(bad) or 'none'}")
    return [m for m in wanted if m in STREET_MODES], [m for m in wanted if m in TRANSIT_MODES]


def _analysed(network, mode: str | None, spark: SparkSession) -> net.Network:
    return load_network(spark, network, mode)


def _nodes_of(network: net.Network, points, edges: DataFrame, side: str, max_snap: float) -> list:
    """Node ids as given, coordinates snapped to a node that can start (``src``) or end (``dst``) a path."""
    listed = points if isinstance(points, list) else [points]
    if not listed:
        raise ValueError("there must be a point")
    is_place = lambda p: isinstance(p, tuple) and len(p) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in p)
    places = [(i, float(p[0]), float(p[1])) for i, p in enumerate(listed) if is_place(p)]
    out = dict(enumerate(listed))
    if places:
        spark = network.nodes.sparkSession
        fit = network.nodes.join(edges.select(F.col(side).alias("node_id")).distinct(), "node_id", "left_semi")
        for r in net.snap(spark.createDataFrame(places, "point_id int, x double, y double"), fit, max_snap).collect():
            out[r["point_id"]] = r["node_id"]
    given = [v for i, v in out.items() if not is_place(listed[i])]
    if given:
        known = {r[0] for r in network.nodes.where(F.col("node_id").isin(given)).select("node_id").collect()}
        lost = [v for v in given if v not in known]
        if lost:
            raise ValueError(f"no such node: {', '.join(map(str, lost[:5]))}")
    return [out[i] for i in range(len(listed))]


def shortest_path(network, origins, destinations, threshold: float | None = None, *, mode: str | None = None, weight: str = "tts", max_snap_distance: float = 250.0, geometry: bool = True, spark: SparkSession | None = None) -> DataFrame:
    """Shortest paths of all pairs within ``threshold`` (minutes of ``tts``, metres of ``length``), in the order given."""
    spark = spark or SparkSession.getActiveSession()
    own = _analysed(network, mode, spark)
    edges = net.matrix_edges(own)
    start = _nodes_of(own, origins, edges, "src", max_snap_distance)
    end = _nodes_of(own, destinations, edges, "dst", max_snap_distance)
    pairs = net.shortest_paths(own, start, end, threshold, weight)
    if geometry:
        pairs = cut(pairs)
        costs = cut(net.travel_costs(edges, pairs.select("origin"), own.weight(weight), None if threshold is None else net.in_units(threshold, weight)))
        pairs = pairs.join(net.path_lines(costs, pairs, own.nodes), ["origin", "destination"], "left")
    return pairs.orderBy("origin_pos", "destination_pos").drop("origin_pos", "destination_pos")


def isochrones(network, origins, cutoffs, *, mode: str | None = None, weight: str = "tts", method: str = "edges", merge_origins: bool = False, max_snap_distance: float = 250.0, buffer_distance: float = 25.0, tile: float = 500.0, spark: SparkSession | None = None) -> DataFrame:
    """``(origin, cutoff, n_nodes, area, rings array<array<struct<x, y>>>)``: what is reached of each origin by each cutoff.

    ``edges``: the places within ``buffer_distance`` of a reached stretch of street, in pieces by tiles that
    don't overlap (a row each), ``area`` being the piece's; together they are the isochrone.  ``hull``: the
    convex hull of the reached nodes and ends of stretches, one row, if they span one.
    """
    if method not in ("edges", "hull"):
        raise ValueError("method must be edges or hull")
    spark = spark or SparkSession.getActiveSession()
    own = _analysed(network, mode, spark)
    weight = own.weight(weight)
    limits = net.cutoffs_of(cutoffs, weight)
    edges = net.matrix_edges(own)
    start = _nodes_of(own, origins, edges, "src", max_snap_distance)
    kind = own.nodes.schema["node_id"].dataType.simpleString()
    given = spark.createDataFrame([(v,) for v in dict.fromkeys(start)], f"origin {kind}")
    costs = net.travel_costs(edges, given, weight, limits[-1][1], merged=merge_origins)
    costs = costs.withColumn("origin", F.lit(";".join(map(str, start))) if merge_origins else F.col("origin").cast("string"))
    costs = cut(costs.select("origin", "node", "cost"))
    counts = net.reach(costs, limits)
    rings = None
    for value, limit in limits:
        drawn = net.distinct_segments(net.reach_segments(costs, edges, own.nodes, weight, limit)).select("origin", F.lit(float(value)).alias("cutoff"), "x1", "y1", "x2", "y2")
        reached = costs.where(F.col("cost") <= limit).join(own.nodes.select(F.col("node_id").alias("node"), "x", "y"), "node").where("x is not null and y is not null").select("origin", F.lit(float(value)).alias("cutoff"), "x", "y")
        if method == "edges":
            # an origin with nowhere to go is a place too
            alone = reached.join(drawn.select("origin").distinct(), "origin", "left_anti").select("origin", "cutoff", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
            part = tiled_union(drawn.unionByName(alone), ["origin", "cutoff"], buffer_distance, max(tile, 4 * buffer_distance)).select("origin", "cutoff", "area", "rings")
        else:
            corners = reached.unionByName(drawn.select("origin", "cutoff", F.col("x2").alias("x"), F.col("y2").alias("y")))
            # hulls of parts first, then the hull of their corners: no origin's nodes meet in one task
            schema = "origin string, cutoff double, x double, y double"
            first = corners.withColumn("_p", F.pmod(F.xxhash64("x", "y"), F.lit(64))).groupBy("origin", "cutoff", "_p").applyInPandas(lambda g: pd.DataFrame(convex_hull(g[["x", "y"]].to_numpy(float)), columns=["x", "y"]).assign(origin=g["origin"].iloc[0], cutoff=g["cutoff"].iloc[0])[["origin", "cutoff", "x", "y"]], schema)

            def outer(g: pd.DataFrame) -> pd.DataFrame:
                hull = convex_hull(g[["x", "y"]].to_numpy(float))
                made = [[{"x": float(x), "y": float(y)} for x, y in hull]]
                return g[["origin", "cutoff"]].iloc[: int(len(hull) > 2)].assign(area=ring_area(hull) if len(hull) > 2 else 0.0, rings=pd.Series([made] * int(len(hull) > 2), dtype=object, index=g.index[: int(len(hull) > 2)]))

            part = first.groupBy("origin", "cutoff").applyInPandas(outer, "origin string, cutoff double, area double, rings array<array<struct<x:double,y:double>>>")
        rings = part if rings is None else rings.unionByName(part)
    return counts.join(rings, ["origin", "cutoff"], "left").orderBy("origin", "cutoff")


def build_network(spark: SparkSession, output: str | Path, *, modes: Sequence[str], streets: Mapping[str, tuple[DataFrame, DataFrame]] | None = None, feeds=None, catalogue: DataFrame | None = None, provinces: Sequence[int | str] = (), fetch: Callable | None = None, area=None, connect_parts: bool = True, simplify: bool = False, date=None, hours: tuple[int, int] | None = None, band: int = 1, periods: Mapping[str, tuple[int, int]] | None = None, formats: Sequence[str] = ("parquet",), schedule: bool = False) -> dict:
    """Networks of all modes written under ``output``; returns a manifest.

    ``streets``: per street mode ``(vertices, edges)`` of a street graph in metres, which is cut to ``area``
    (its parts connected).  ``feeds``: local feeds; ``catalogue``: published datasets, of which those of
    ``provinces`` and the wanted modes are fetched by ``fetch(file) -> bytes``.  Each transit dataset gets its
    layers, its matrix and a node-link graph.  A feed that can't be read, has no service that day or nothing
    in the area is a row of the report, not an end of the work.
    """
    street, transit = split_modes(modes)
    day, sources = service_date(date), [("user", name, source, {}) for name, source in named_feeds(feeds)]
    files: list[str] = []
    unconnected: dict[str, list[int]] = {}
    for mode in street:
        if not streets or mode not in streets:
            raise ValueError(f"no street graph is given for {mode}")
        vertices, edges = streets[mode]
        if area is not None:
            vertices, edges, unconnected[mode] = area_streets(vertices, edges, area, connect=connect_parts)
        if simplify:
            vertices, edges = simplified(vertices, edges)
            # a tag that is on or off is on if any edge of the chain has it on
            edges = edges.withColumns({c: F.exists(c, lambda x: x == "true") for c in ("oneway", "reversed", "connector") if c in edges.columns})
        nodes, done = street_layers(edges, vertices, mode)
        files += [f for form in formats for f in write_layers({"nodes": nodes, "edges": done}, f"{output}/{mode}", form)]
        own = net.build_matrix(nodes, done, ("tts", "length"), meta={"layer": mode, "units": {"tts": "s", "length": "m"}})
        files.append(str(write_matrix(own, f"{output}/{mode}/matrix.npz")))
    report, names = [], []
    if catalogue is not None:
        wanted, left_out = catalogue_files(catalogue, [province_code(p) for p in provinces], [t for m in transit for t in CATALOGUE_TYPES[m]])
        report += [{"source": "catalogue", **r.asDict()} for r in left_out.collect()]
        listed = [r.asDict() for r in wanted.orderBy("file_id").collect()]  # a row per published file of the area's provinces
        for row in fetch_files(listed, f"{output}/feeds", fetch):
            if row["status"] == "failed":
                report.append({**row, "source": "catalogue"})
            else:
                sources.append(("catalogue", None, f"{output}/feeds/{row.get('file_name') or str(row['file_id']) + '.zip'}", row))
    codes = None if periods is None else list(periods)
    for origin, name, source, told in sources:
        row = {**told, "source": origin, "file_name": Path(source).name, "status": "failed", "error": None}
        try:
            feed = read_feed(spark, source)
            mode = feed_mode(feed["routes"]).first()["mode"]
            dataset = unique_name(name or feed_name(Path(source).name), names)
            row |= {"dataset": dataset, "mode": mode}
            missing = no_service(feed, day) if day is not None else ""
            if mode not in transit:
                row["status"] = "skipped_mode"
            elif missing:
                row |= {"status": "no_service_on_date", "error": missing}
            else:
                done = normalize_feed(feed, dataset=dataset, area=area, date=day, hours=hours, band=band, periods=periods)
                edges, stops = cut(output_edges(done["edges"], codes)), cut(done["nodes"])
                n = edges.count()
                row |= {"status": "written" if n else "nothing_in_area", "edges": n}
                if n:
                    names.append(dataset)
                    row["stops"], row["routes"] = stops.count(), edges.select("route_id").distinct().count()
                    folder = f"{output}/{mode}/{dataset}"
                    layers = {"nodes": output_stops(stops), "edges": edges, **({"schedule": done["schedule"]} if schedule else {})}
                    files += [f for form in formats for f in write_layers(layers, folder, form)]
                    own = net.transit_network(stops, edges, mode=mode, dataset=dataset, periods=periods)
                    files += [str(write_matrix(own, f"{folder}/matrix.npz")), str(node_link(stops.drop("dataset_name", "node_type"), done["edges"], f"{folder}/graph.json"))]
        except Exception as e:  # the report says what failed
            row |= {"status": "failed_processing", "error": str(e)[:500]}
        report.append(row)
    if report:
        files.append(str(write_report(spark, report, f"{output}/gtfs_report.csv")))
    return {"modes": street + transit, "street_modes": street, "gtfs_datasets": names, "formats": list(formats), "output_dir": str(output), "files": files, "report": report, "unconnected_parts": unconnected}
