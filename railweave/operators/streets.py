"""Street graphs: vertices and their roles, splitting lines at nodes, travel times and the final layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.functions.geo import distance_to, point_inside, segment_meets
from railweave.functions.polygons import ring_area
from railweave.functions.tags import flat_list, road_class, speed_kmh, travel_seconds
from railweave.operators.areas import convex_hull
from railweave.operators.network import connect_parts
from railweave.scale import cut

#: The columns of the edge layer, in order.
EDGE_LAYER = ("edge_id", "from_node", "to_node", "highway", "hwy_raw", "lanes", "maxspeed", "spd_raw", "name", "oneway", "reversed", "length", "tts", "connector", "geometry")


def millimetres(x: Column) -> Column:
    """A coordinate rounded half to even to 3 decimals; -0.0 is 0.0."""
    return F.bround(x, 3) + 0.0


def _vertices(edges: DataFrame) -> DataFrame:
    """``(edge, pos, x, y, kx, ky, n)``: all vertices of all lines, with their millimetre keys."""
    each = edges.select(F.col("edge"), F.size("geometry").alias("n"), F.posexplode("geometry").alias("pos", "p"))
    return each.select("edge", "n", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"), millimetres(F.col("p.x")).alias("kx"), millimetres(F.col("p.y")).alias("ky"))


def role(degree: Column, ends: Column) -> Column:
    """A vertex's role by the segments that meet there and how often it ends a line."""
    return F.when(degree == 0, "isolated_vertex").when(degree == 1, "endpoint").when((degree == 2) & (ends > 0), "through_endpoint").when(degree == 2, "linear_vertex").otherwise("intersection")


def topology_nodes(edges: DataFrame, *, undirected: bool = False) -> DataFrame:
    """``(kx, ky, x, y, vertex_occurrences, endpoint_occurrences, incident_segments, incident_features, node_role)``.

    ``edges(edge, geometry array<struct<x, y>>)`` in metres.  Vertices are the same to the millimetre; their
    place is that of the first occurrence (least edge and position).  A pair of successive, different
    vertices is a segment of both.  ``undirected``: a segment drawn both ways counts once.
    """
    v = _vertices(edges)
    w = Window.partitionBy("edge").orderBy("pos")
    v = v.withColumn("bx", F.lag("kx").over(w)).withColumn("by", F.lag("ky").over(w)).withColumn("ax", F.lead("kx").over(w)).withColumn("ay", F.lead("ky").over(w))
    first, last = F.first(F.struct("kx", "ky")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(F.struct("kx", "ky")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = F.struct("kx", "ky")
    other = lambda x, y: (F.col(x).isNotNull() & ((F.col(x) != F.col("kx")) | (F.col(y) != F.col("ky")))).cast("int")
    v = v.withColumn("end", ((own == first) | (own == last)).cast("int"))
    counted = v.groupBy("kx", "ky").agg(
        F.min(F.struct("edge", "pos", "x", "y")).alias("m"),
        F.count("*").alias("vertex_occurrences"),
        F.sum("end").alias("endpoint_occurrences"),
        F.sum(other("bx", "by") + other("ax", "ay")).alias("incident_segments"),
        F.count_distinct("edge").alias("incident_features"),
    )
    if undirected:
        seg = v.where(other("ax", "ay") == 1).select(F.struct("kx", "ky").alias("a"), F.struct(F.col("ax").alias("kx"), F.col("ay").alias("ky")).alias("b"))
        once = seg.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        degree = once.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k.kx", "k.ky").agg(F.count("*").alias("incident_segments"))
        counted = counted.drop("incident_segments").join(degree, ["kx", "ky"], "left").fillna({"incident_segments": 0})
    return counted.select("kx", "ky", F.col("m.x").alias("x"), F.col("m.y").alias("y"), "vertex_occurrences", "endpoint_occurrences", "incident_segments", "incident_features", role(F.col("incident_segments"), F.col("endpoint_occurrences")).alias("node_role"))


def role_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_role").agg(F.count("*").alias("n"))


def name_nodes(nodes: DataFrame, layer: str, known: DataFrame | None = None) -> DataFrame:
    """``nodes`` with ``node_id``: the street vertex's at the same millimetre, else one made from the place.

    ``known(node_id, x, y, highway)`` are the street graph's own vertices (one per place: the least id).
    A made id is ``layer_topology_node_`` and the place in millimetres, so it doesn't depend on the order.
    """
    made = F.concat(F.lit(f"{layer}_topology_node_"), F.bround(F.col("kx") * 1000).cast("bigint").cast("string"), F.lit("_"), F.bround(F.col("ky") * 1000).cast("bigint").cast("string"))
    if known is None:
        return nodes.withColumn("node_id", made).withColumn("node_tag", F.lit(None).cast("string"))
    tag = F.col("highway") if "highway" in known.columns else F.lit(None).cast("string")
    own = known.where(F.col("node_id").isNotNull()).select(millimetres(F.col("x")).alias("kx"), millimetres(F.col("y")).alias("ky"), F.struct(F.col("node_id").cast("string").alias("i"), tag.alias("t")).alias("o")).groupBy("kx", "ky").agg(F.min("o").alias("o"))
    return nodes.join(own, ["kx", "ky"], "left").withColumn("node_id", F.coalesce("o.i", made)).withColumn("node_tag", F.col("o.t")).drop("o")


def split_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each line cut at its first, last and every inner vertex that is a node, in order.

    Gives ``(edge, part, from_node, to_node, length, geometry)``: a part's length is the edge's length times
    its share of the planar length (a line without extent counts as 1e-12 long).
    """
    cuts = nodes.where(F.col("node_role").isin("intersection", "through_endpoint", "linear_vertex")).select("kx", "ky", F.lit(True).alias("cut"))
    v = _vertices(edges).join(cuts, ["kx", "ky"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)) | (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1))
    w = Window.partitionBy("edge").orderBy("pos")
    v = v.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("part", F.sum(F.col("cut").cast("int")).over(run)).withColumn("at", F.sum("step").over(run))
    # a cut vertex ends one part and begins the next
    begins = v.withColumn("p", F.col("part"))
    ends = v.where(F.col("cut") & (F.col("pos") > 0)).withColumn("p", F.col("part") - 1)
    both = begins.where(~(F.col("cut") & (F.col("pos") == F.col("n") - 1))).unionByName(ends)
    point = F.struct("pos", "x", "y", "kx", "ky", "at")
    parts = both.groupBy("edge", "p").agg(F.array_sort(F.collect_list(point)).alias("v")).where(F.size("v") >= 2)
    length = edges.select("edge", F.col("length").cast("double").alias("_whole"))
    total = v.groupBy("edge").agg(F.max("at").alias("_planar"))
    parts = parts.join(total.join(length, "edge"), "edge")
    first, last = F.element_at("v", 1), F.element_at("v", -1)
    planar = last["at"] - first["at"]
    name = lambda a, b, c: nodes.select(F.col("kx").alias(a), F.col("ky").alias(b), F.col("node_id").alias(c))
    out = parts.select("edge", F.col("p").alias("part"), first["kx"].alias("_fx"), first["ky"].alias("_fy"), last["kx"].alias("_tx"), last["ky"].alias("_ty"), (F.col("_whole") * planar / F.greatest(F.col("_planar"), F.lit(1e-12))).alias("length"), F.transform("v", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("geometry"))
    out = out.join(name("_fx", "_fy", "from_node"), ["_fx", "_fy"], "left").join(name("_tx", "_ty", "to_node"), ["_tx", "_ty"], "left")
    return out.select("edge", "part", "from_node", "to_node", "length", "geometry")


def street_layers(edges: DataFrame, vertices: DataFrame, mode: str, *, layer: str | None = None, undirected: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` layers of a street graph: topology, split, one row per way, flat tags and travel times.

    ``edges(u, v, key, osmid, highway, maxspeed, lanes, name, oneway, reversed, length, geometry)`` where the
    tags may be lists; ``vertices(node_id, x, y, highway)``.  Coordinates are metres.
    """
    listed = lambda c: (F.col(c) if dict(edges.dtypes)[c].startswith("array") else F.array(F.col(c))).cast("array<string>") if c in edges.columns else F.lit(None).cast("array<string>")
    keyed = edges.withColumn("edge", F.concat_ws("_", F.col("u").cast("string"), F.col("v").cast("string"), F.col("key").cast("string")))
    keyed = cut(ends_geometry(keyed, vertices))
    nodes = cut(name_nodes(topology_nodes(keyed, undirected=undirected), layer or mode, vertices))
    parts = split_edges(keyed, nodes)
    flat = lambda c: flat_list(listed(c))
    about = keyed.select("edge", F.explode_outer(listed("osmid")).alias("edge_id"), flat("highway").alias("hwy_raw"), flat("lanes").alias("lanes"), flat("maxspeed").alias("spd_raw"), flat("name").alias("name"), *[(F.col(c) if c in edges.columns else F.lit(None)).cast("boolean").alias(c) for c in ("oneway", "reversed")], (F.coalesce("connector", F.lit(False)) if "connector" in edges.columns else F.lit(False)).alias("connector"))
    joined = parts.join(about, "edge").join(nodes.select(F.col("node_id").alias("to_node"), "node_tag", "node_role"), "to_node", "left")
    speed = speed_kmh(F.col("spd_raw"))
    done = joined.withColumn("highway", road_class(F.col("hwy_raw"))).withColumn("maxspeed", speed).withColumn("tts", travel_seconds(mode, F.col("length"), F.col("hwy_raw"), speed, F.col("node_tag"), F.col("node_role")))
    return nodes.select("node_id", "node_role", "x", "y"), done.select(*EDGE_LAYER)


def parts_by_size(area) -> list:
    """The polygons of an area, the largest first: part 1 is the main one."""
    return sorted(area, key=lambda polygon: -(abs(ring_area(polygon[0])) - sum(abs(ring_area(h)) for h in polygon[1:])))


def clip_lines(lines: DataFrame, area) -> DataFrame:
    """The rows whose ``geometry array<struct<x, y>>`` meets ``area``; lines without a geometry go."""
    pairs = F.arrays_zip(F.slice("geometry", 1, F.size("geometry") - 1).alias("p"), F.slice("geometry", 2, F.size("geometry") - 1).alias("q"))
    meets = F.exists(pairs, lambda s: segment_meets(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"], area))
    return lines.where(F.coalesce((F.size("geometry") > 1) & meets, F.lit(False)))


def area_streets(vertices: DataFrame, edges: DataFrame, area, *, connect: bool = True, margin: float = 1000.0) -> tuple[DataFrame, DataFrame, list[int]]:
    """``(vertices, edges, unconnected)`` of a street graph cut to an area.

    An edge stays if one of its ends lies in the area.  If the area has several parts with streets, the
    shortest ways from the main part to each other and back are added from the streets within ``margin`` of
    the hull of all parts, marked ``connector``; ``unconnected`` lists the parts (1 is the largest) that can't
    be reached both ways.
    """
    parts = parts_by_size(area)
    part = F.coalesce(*[F.when(point_inside(F.col("x"), F.col("y"), [p]), k) for k, p in enumerate(parts, 1)])
    placed = cut(vertices.withColumn("_part", part))
    inside = placed.where(F.col("_part").isNotNull()).select("node_id", "_part")
    ids = inside.select("node_id")
    marked = edges.join(ids.select(F.col("node_id").alias("u"), F.lit(True).alias("_u")), "u", "left").join(ids.select(F.col("node_id").alias("v"), F.lit(True).alias("_v")), "v", "left")
    # what later steps read several times is written once, so that plans don't grow with each use
    kept = cut(marked.where("_u or _v").drop("_u", "_v").select(*edges.columns).withColumn("connector", F.lit(False)))
    own = kept.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    if not connect or len(parts) < 2:
        return cut(vertices.join(own, "node_id", "left_semi")), kept, []
    hull = convex_hull(np.array([p for polygon in parts for p in polygon[0]], float))
    near = placed.where(distance_to(F.col("x"), F.col("y"), [[[tuple(map(float, p)) for p in hull]]]) <= margin).select("node_id")
    around = edges.join(near.select(F.col("node_id").alias("u")), "u", "left_semi").join(near.select(F.col("node_id").alias("v")), "v", "left_semi")
    main = inside.agg(F.min("_part")).first()[0]
    # the first part that has streets is the main one
    numbered = inside.select(F.col("node_id").alias("node"), F.when(F.col("_part") == main, 1).otherwise(F.col("_part") + 1).alias("part"))
    links, missing = connect_parts(around.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("length").cast("double").alias("length")), numbered)
    # of parallel edges the shortest one leads on
    ways = links.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    shortest = around.join(ways, ["u", "v"], "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("u", "v").orderBy(F.col("length").cast("double"), "key"))).where("_n = 1").select(*edges.columns)
    added = shortest.join(kept.select("u", "v", "key"), ["u", "v", "key"], "left_anti").select(*edges.columns).withColumn("connector", F.lit(True))
    done = cut(kept.unionByName(added))
    used = done.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return cut(vertices.join(used, "node_id", "left_semi")), done, sorted(r["part"] - 1 for r in missing.collect())


def simplified(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vertices, edges)`` where a chain of edges through vertices that only lead on is one edge.

    A vertex stays if a loop begins there, nothing leads to it or from it, or it hasn't just two neighbours,
    each with one edge or an edge each way.  An edge's ``geometry`` and ``osmid`` are those of its chain in
    order, ``length`` the sum, other tags the distinct values in order.  Rings without a vertex that stays
    are left as they are.  Chains double their known length each round.
    """
    listed = lambda c: (F.col(c) if dict(edges.dtypes)[c].startswith("array") else F.array_compact(F.array(F.col(c)))).cast("array<string>")
    tags = [c for c in edges.columns if c not in ("u", "v", "key", "length", "geometry")]
    ends = edges.select(F.col("u").alias("n"), F.col("v").alias("m"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    seen = ends.groupBy("n").agg(F.approx_count_distinct("m").alias("_"), F.sum("o").alias("out"), F.sum("i").alias("in"), F.min("m").alias("a"), F.max("m").alias("b"), F.max((F.col("m") == F.col("n")).cast("int")).alias("loop"), F.count_if(F.lit(True)).alias("d")).drop("_")
    other = ends.join(seen.select("n", "a", "b"), "n").groupBy("n").agg(F.max(((F.col("m") != F.col("a")) & (F.col("m") != F.col("b"))).cast("int")).alias("third"))
    through = cut(seen.join(other, "n").where("loop = 0 and out > 0 and `in` > 0 and a <> b and third = 0 and d in (2, 4)").select("n"))
    straight = ends_geometry(edges, vertices)
    base = cut(straight.withColumn("_id", F.concat_ws("_", F.col("u").cast("string"), F.col("v").cast("string"), F.col("key").cast("string"))))
    chain = cut(base.select("_id", "u", "v", F.array("_id").alias("ids")))
    inner = through.select(F.col("n").alias("v"))
    # an edge leads on to the one that leaves its end for another place than its start
    follow = base.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("_id").alias("next"))
    leads = base.select("_id", "u", "v").join(inner, "v").join(follow, "v").where("w <> u").groupBy("_id").agg(F.min("next").alias("next"))
    starts = cut(base.join(through.select(F.col("n").alias("u")), "u", "left_anti").select("_id"))
    state = cut(chain.select("_id", "ids").join(leads, "_id", "left"))
    rounds = 0
    while rounds < 40 and not state.join(starts, "_id", "left_semi").where("next is not null").isEmpty():
        rounds += 1
        onward = state.select(F.col("_id").alias("next"), F.col("ids").alias("more"), F.col("next").alias("then"))
        state = cut(state.join(onward, "next", "left").select("_id", F.when(F.col("more").isNull(), F.col("ids")).otherwise(F.concat("ids", "more")).alias("ids"), F.col("then").alias("next")))
    made = state.join(starts, "_id", "left_semi").select(F.col("_id").alias("_first"), F.posexplode("ids").alias("_k", "_id"))
    made = cut(made)
    rings = base.join(made.select("_id"), "_id", "left_anti").select(F.col("_id").alias("_first"), F.lit(0).alias("_k"), "_id")
    parts = made.unionByName(rings).join(base, "_id")
    first, last = (lambda c: F.min_by(c, "_k")), (lambda c: F.max_by(c, "_k"))
    merged = parts.groupBy("_first").agg(
        first("u").alias("u"), last("v").alias("v"), first("key").alias("key"), F.sum(F.col("length").cast("double")).alias("length"),
        F.array_sort(F.collect_list(F.struct("_k", "geometry"))).alias("_g"), *[F.array_sort(F.collect_list(F.struct("_k", listed(c).alias("t")))).alias(f"_{c}") for c in tags],
    )
    line = F.aggregate("_g", F.array().cast(straight.schema["geometry"].dataType), lambda a, p: F.concat(a, F.when(F.size(a) == 0, p["geometry"]).otherwise(F.slice(p["geometry"], F.lit(2), F.size(p["geometry"])))))
    values = lambda c: F.array_distinct(F.flatten(F.transform(f"_{c}", lambda p: F.coalesce(p["t"], F.array().cast("array<string>")))))
    done = cut(merged.select("u", "v", "key", *[values(c).alias(c) for c in tags], "length", line.alias("geometry")))
    left = done.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return cut(vertices.join(left, "node_id", "left_semi")), done


def ends_geometry(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``edges`` where each has a geometry: the straight line between its ends if it has none."""
    place = lambda k: vertices.select(F.col("node_id").alias(k), F.struct("x", "y").alias(f"_{k}"))
    own = F.col("geometry") if "geometry" in edges.columns else F.lit(None).cast("array<struct<x:double,y:double>>")
    joined = edges.withColumn("geometry", own).join(place("u"), "u", "left").join(place("v"), "v", "left")
    return joined.withColumn("geometry", F.when(F.col("geometry").isNull() | (F.size("geometry") < 2), F.array("_u", "_v")).otherwise(F.col("geometry"))).drop("_u", "_v")


def largest_component(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges whose ends lie in the component with most nodes (the smaller name among equals)."""
    top = members.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    kept = members.join(F.broadcast(top.select("component")), "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(kept, "src", "left_semi")
