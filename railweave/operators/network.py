"""Directed weighted networks: building the matrix, costs within a limit, shortest paths and reach.

A network is a table of nodes and a table of edges in the form of a sparse matrix: ``(row, col, weights)``
sorted by row and column, one entry per pair.  Costs are found by relaxation: the frontier of improved
(origin, node) is joined with the edges round by round and only strict improvements go on, so cycles of
zero weight end.  Lineage is cut in the shared checkpoint folder, every few rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.operators.near import nearest
from railweave.operators.timetable import period_codes, transit_weights, with_ordinal
from railweave.scale import cut, lookup_join, numbered

INF = float("inf")
#: What ``kernel_edges`` may be set to where a network is known to fit the tasks' memory (24 bytes an edge).
KERNEL_EDGES = 2_000_000


@dataclass
class Network:
    """``nodes(row, node_id, x, y, in_area, ...)``, ``edges(row, col, weights...)`` and what is known about them."""

    nodes: DataFrame
    edges: DataFrame
    weights: tuple[str, ...]
    meta: dict = field(default_factory=dict)

    @property
    def default_weight(self) -> str:
        wanted = self.meta.get("default_weight")
        return wanted if wanted in self.weights else self.weights[0]

    def n_nodes(self) -> int:
        return self.nodes.count()

    def n_edges(self) -> int:
        return self.edges.count()

    def weight(self, name: str | None) -> str:
        name = name or self.default_weight
        if name not in self.weights:
            raise KeyError(f"no weight {name!r}; there are {', '.join(self.weights)}")
        return name


def missing_endpoints(nodes: DataFrame, edges: DataFrame, from_node: str = "from_node", to_node: str = "to_node") -> DataFrame:
    """``(node_id, x, y, in_area, _at)``: ends of edges that no node has, in order of first appearance.

    All missing *from* ends come before the *to* ends.  Places come from edge columns ``from_x, from_y,
    to_x, to_y`` where there are any: the first known of the node.
    """
    edges = with_ordinal(edges)
    place = lambda c: F.col(c).cast("double") if c in edges.columns else F.lit(None).cast("double")
    side = lambda i, c, x, y: edges.select(F.col(c).alias("node_id"), F.lit(i).alias("side"), "_ordinal", place(x).alias("x"), place(y).alias("y"))
    ends = side(0, from_node, "from_x", "from_y").unionByName(side(1, to_node, "to_x", "to_y")).where(F.col("node_id").isNotNull())
    lost = ends.join(nodes.select("node_id").distinct(), "node_id", "left_anti")
    at = F.struct("side", "_ordinal")
    return lost.groupBy("node_id").agg(F.min_by("x", F.when(F.col("x").isNotNull(), at)).alias("x"), F.min_by("y", F.when(F.col("y").isNotNull(), at)).alias("y"), F.min(at).alias("_at")).withColumn("in_area", F.lit(False))


def build_matrix(nodes: DataFrame, edges: DataFrame, weights: Sequence[str], *, from_node: str = "from_node", to_node: str = "to_node", meta: dict | None = None, check: bool = True) -> Network:
    """The network matrix of a node and an edge table.

    Rows follow the node table's order, then the missing ends (outside the area).  Null weights are edges
    that can't be travelled (infinite); loops are dropped; of parallel edges each weight has its own
    least; zero weights stay.  Raises ``ValueError`` for repeated node ids or without any weight column.
    """
    weights = tuple(w for w in weights if w in edges.columns)
    if not weights:
        raise ValueError("the edges have none of the weight columns")
    nodes = with_ordinal(nodes)
    if check:
        twice = nodes.groupBy("node_id").count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"repeated node ids: {', '.join(str(r['node_id']) for r in twice)}")
    column = lambda c, t: F.col(c).cast(t) if c in nodes.columns else F.lit(None).cast(t)
    known = nodes.select("node_id", column("x", "double").alias("x"), column("y", "double").alias("y"), F.coalesce(column("in_area", "boolean"), F.lit(True)).alias("in_area"), F.struct(F.lit(-1).alias("side"), F.col("_ordinal").alias("_ordinal")).alias("_at"))
    rows = numbered(known.unionByName(missing_endpoints(nodes, edges, from_node, to_node)), ["_at"], "row").drop("_at")
    rows = cut(rows)
    index = rows.select("node_id", "row")
    number = lambda w: F.coalesce(F.when(~F.isnan(F.col(w).cast("double")), F.col(w).cast("double")), F.lit(INF)).alias(w)
    placed = edges.select(F.col(from_node).alias("_f"), F.col(to_node).alias("_t"), *map(number, weights)).where("_f <> _t")
    placed = placed.join(index.select(F.col("node_id").alias("_f"), F.col("row")), "_f").join(index.select(F.col("node_id").alias("_t"), F.col("row").alias("col")), "_t")
    entries = placed.groupBy("row", "col").agg(*[F.min(w).alias(w) for w in weights])
    return Network(rows, cut(entries), weights, dict(meta or {}))


def transit_network(stops: DataFrame, edges: DataFrame, *, mode: str, dataset: str, periods=None, meta: dict | None = None) -> Network:
    """The network of a timetable's final layers, ``edges`` under their short names; ids are text.

    Weights are the travel times that the edges have, the overall mean being the default.  Stops keep their
    ``in_area``; ends of edges that no stop has are appended outside the area.  ``periods`` (name: hours) and
    their codes are told in the metadata.
    """
    text = {c: F.col(c).cast("string") for c in ("from_node", "to_node")}
    nodes = stops.withColumn("node_id", F.col("node_id").cast("string"))
    told = {"mode": mode, "dataset": dataset, "layer": f"{mode}/{dataset}", "default_weight": "tts_m", "units": "s", "periods": {k: list(v) for k, v in periods.items()} if periods else None, "period_codes": period_codes(None if periods is None else list(periods))}
    return build_matrix(nodes, edges.withColumns(text), transit_weights(None if periods is None else list(periods)), meta=told | (meta or {}))


def row_offsets(network: Network) -> DataFrame:
    """``(row, start, size)``: where each node's entries begin in the sorted matrix; one row per node."""
    sizes = network.nodes.select("row").join(network.edges.groupBy("row").agg(F.count("*").alias("size")), "row", "left").fillna({"size": 0})
    upto = Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    # a running sum over the nodes: by blocks of rows, so that only the blocks' sums pass one task
    block = sizes.withColumn("_b", F.floor(F.col("row") / 65536))
    inner = Window.partitionBy("_b").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    sums = block.groupBy("_b").agg(F.sum("size").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(upto.orderBy("_b")), F.lit(0))).drop("_s")
    out = lookup_join(block.withColumn("_i", F.coalesce(F.sum("size").over(inner), F.lit(0))), sums, ["_b"], "inner")
    return out.select("row", (F.col("_o") + F.col("_i")).cast("long").alias("start"), F.col("size").cast("long").alias("size"))


def csr(network: Network, weight: str | None = None) -> tuple:
    """``(indptr, indices, data)`` as NumPy arrays on the driver, for small networks."""
    weight = network.weight(weight)
    table = network.edges.select("row", "col", weight).orderBy("row", "col").toPandas()
    counts = np.bincount(table["row"].to_numpy(int), minlength=network.n_nodes()) if len(table) else np.zeros(network.n_nodes(), int)
    return np.r_[0, np.cumsum(counts)], table["col"].to_numpy(int), table[weight].to_numpy(float)


def travel_costs(edges: DataFrame, origins: DataFrame, weight: str, limit: float | None = None, *, merged: bool = False, extra: Sequence[str] = (), every: int = 4, kernel_edges: int = 0) -> DataFrame:
    """``(origin, node, cost, before, n_edges, extra...)``: least costs from each origin, up to ``limit`` (included).

    ``edges(src, dst, weight, extra...)``; ``origins(origin)`` are nodes.  ``before`` is the node before on
    the path, ``extra`` columns are summed along it.  Ties are decided by fewer edges, then the smaller
    node before.  ``merged``: the least over all origins, ``origin`` being the one it comes from.

    Networks are relaxed round by round with joins, whatever their size.  A caller may state by ``kernel_edges``
    that a network of as many edges fits each task: one that small is sent to the tasks, which search from
    their own origins with a heap and give the same.  Merged origins are always relaxed, all seeded at once.
    """
    usable = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col(weight).cast("double").alias("_w"), *[F.col(c).cast("double").alias(f"_x_{c}") for c in extra])
    usable = cut(usable.where(F.col("_w").isNotNull() & (F.col("_w") < INF) & (F.col("_w") >= 0)))
    kind = edges.schema["src"].dataType.simpleString()
    if kernel_edges and not merged and usable.limit(kernel_edges + 1).count() <= kernel_edges:
        return _searched(usable, origins, kind, limit, list(extra))
    key = ["node"] if merged else ["origin", "node"]
    rest = ["n_edges", "before", *extra, *(["origin"] if merged else [])]
    best = F.struct("cost", *rest)
    state = origins.select(F.col("origin").cast(kind)).distinct().select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("n_edges"), F.lit(None).cast(kind).alias("before"), *[F.lit(0.0).alias(c) for c in extra])
    state = cut(state)
    frontier, rounds = state, 0
    while True:
        rounds += 1
        step = frontier.join(usable, frontier["node"] == usable["_s"])
        step = step.select("origin", F.col("_d").alias("node"), (F.col("cost") + F.col("_w")).alias("cost"), (F.col("n_edges") + 1).alias("n_edges"), F.col("_s").alias("before"), *[(F.col(c) + F.col(f"_x_{c}")).alias(c) for c in extra])
        if limit is not None:
            step = step.where(F.col("cost") <= limit)
        new = step.groupBy(*key).agg(F.min(best).alias("b"))
        new = new.select(*key, "b.*")
        held = state.select(*key, F.col("cost").alias("_old"))
        # an equal cost isn't an improvement, so the path found with fewer rounds stays
        improved = cut(new.join(held, key, "left").where(F.col("_old").isNull() | (F.col("cost") < F.col("_old"))).drop("_old").select(*state.columns))
        if improved.isEmpty():
            break
        state = state.join(improved.select(*key), key, "left_anti").select(*state.columns).unionByName(improved)
        if rounds % every == 0:
            state = cut(state)
        frontier = improved
    return state


def _searched(usable: DataFrame, origins: DataFrame, kind: str, limit: float | None, extra: list[str]) -> DataFrame:
    """``travel_costs`` by a heap in each task, over a compressed sparse row copy of a bounded network."""
    table = usable.toPandas()
    ids = np.unique(np.concatenate([table["_s"].to_numpy(), table["_d"].to_numpy()])) if len(table) else np.array([])
    s, d = np.searchsorted(ids, table["_s"].to_numpy()), np.searchsorted(ids, table["_d"].to_numpy())
    order = np.argsort(s, kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(s, minlength=len(ids)))] if len(table) else np.zeros(1, int)
    sent = usable.sparkSession.sparkContext.broadcast((ids, start, d[order], table["_w"].to_numpy(float)[order], [table[f"_x_{c}"].to_numpy(float)[order] for c in extra]))
    top = INF if limit is None else limit

    def search(starts: list) -> list[tuple]:
        names, begin, to, weight_, sums = sent.value
        heap, done, out = [], set(), []
        for o in starts:
            k = int(np.searchsorted(names, o)) if len(names) else 0
            known = k < len(names) and names[k] == o
            if not known:  # a node without edges reaches itself only
                out.append((o, o, 0.0, None, 0, *[0.0] * len(sums)))
            else:
                heap.append((0.0, 0, -1, k, o, tuple(0.0 for _ in sums)))
        heapq.heapify(heap)
        while heap:
            cost, n, b, k, o, along = heapq.heappop(heap)
            if k in done:
                continue
            done.add(k)
            out.append((o, names[k].item() if hasattr(names[k], "item") else names[k], cost, None if b < 0 else (names[b].item() if hasattr(names[b], "item") else names[b]), n, *along))
            for e in range(begin[k], begin[k + 1]):
                j, c = int(to[e]), cost + weight_[e]
                if c <= top and j not in done:
                    heapq.heappush(heap, (c, n + 1, k, j, o, tuple(a + x[e] for a, x in zip(along, sums))))
        return out

    columns = ["origin", "node", "cost", "before", "n_edges", *extra]

    def searched(batches):
        for batch in batches:
            rows = [r for o in batch["origin"] for r in search([o])]
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"before": object})

    schema = f"origin {kind}, node {kind}, cost double, before {kind}, n_edges long" + "".join(f", `{c}` double" for c in extra)
    wanted = origins.select(F.col("origin").cast(kind)).where("origin is not null").distinct()
    # the few rows of origins are dealt to all cores, one search being much work
    rows = wanted.repartition(usable.sparkSession.sparkContext.defaultParallelism * 2).mapInPandas(searched, schema)
    found = cut(rows.select("origin", "node", "cost", "n_edges", "before", *extra))
    return found


def snap(points: DataFrame, nodes: DataFrame, max_distance: float = 250.0, *, strict: bool = True) -> DataFrame:
    """``(point_id, node_id, distance)``: the nearest node of each point ``(point_id, x, y)``, the smaller id among equals.

    They meet in the leaves of a quadtree (``near.nearest``).  Nodes lacking a place are passed over.
    ``strict``: raises ``ValueError`` if a point has no node near enough.
    """
    found = nearest(points.select(F.col("point_id").alias("id"), "x", "y"), nodes.select(F.col("node_id").alias("id"), "x", "y"), max_distance)
    found = found.select(F.col("id").alias("point_id"), F.col("other").alias("node_id"), "distance")
    if strict:
        found = cut(found)
        lost = points.join(found, "point_id", "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"no node within {max_distance} of {', '.join(str(r['point_id']) for r in lost)}")
    return found


def matrix_edges(network: Network) -> DataFrame:
    """The entries with node ids: ``(src, dst, weights...)``."""
    ids = network.nodes.select("row", "node_id")
    with_src = network.edges.join(ids.withColumnRenamed("node_id", "src"), "row")
    return with_src.join(ids.select(F.col("row").alias("col"), F.col("node_id").alias("dst")), "col").select("src", "dst", *network.weights)


def in_units(value: float, weight: str) -> float:
    """A limit as users give it (minutes of time, metres of length) in the weight's own unit."""
    return value * 60.0 if weight.startswith("tts") else float(value)


def shortest_paths(network: Network, origins: Sequence | DataFrame, destinations: Sequence | DataFrame, threshold: float | None = None, weight: str | None = None, kernel_edges: int = 0) -> DataFrame:
    """``(origin_pos, destination_pos, origin, destination, time_min, length_m, n_edges)`` of all pairs within the threshold.

    Pairs come in the order given and repeats are kept; an origin that is its destination has zeros.  Time
    and length are both those of the chosen path; a weight the network lacks is null.  Many ends are given as
    tables, ``(origin_pos, origin)`` and ``(destination_pos, destination)``, and not sent to the driver.
    """
    weight = network.weight(weight)
    spark = network.nodes.sparkSession
    kind = network.nodes.schema["node_id"].dataType.simpleString()
    given = lambda ids, name: spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"{name}_pos int, {name} {kind}")
    table = lambda ids, name: ids if isinstance(ids, DataFrame) else F.broadcast(given(ids, name))
    o, t = table(origins, "origin"), table(destinations, "destination")
    sums = [w for w in ("tts", "length") if w in network.weights]
    edges = matrix_edges(network)
    limit = None if threshold is None else in_units(threshold, weight)
    costs = travel_costs(edges, o.select("origin"), weight, limit, extra=sums, kernel_edges=kernel_edges)
    reached = costs.join(t, costs["node"] == t["destination"]).join(o, "origin")
    value = lambda c, by: (F.col(c) / by if c in sums else F.lit(None)).cast("double")
    return reached.select("origin_pos", "destination_pos", "origin", "destination", value("tts", 60.0).alias("time_min"), value("length", 1.0).alias("length_m"), F.col("n_edges").cast("long").alias("n_edges"))


def path_lines(costs: DataFrame, pairs: DataFrame, nodes: DataFrame, every: int = 4) -> DataFrame:
    """``(origin, destination, line array<struct<x, y>>)``: the path of each pair, followed back from its destination.

    Each round goes back one edge for all pairs at once; a path's points are bounded by its edges.
    """
    at = pairs.select("origin", "destination").distinct().withColumn("node", F.col("destination")).withColumn("k", F.lit(0))
    place = nodes.select("node_id", "x", "y")
    all_steps, rounds = at, 0
    back = costs.select("origin", "node", "before")
    while True:
        rounds += 1
        at = cut(at.join(back, ["origin", "node"]).where(F.col("before").isNotNull()).select("origin", "destination", F.col("before").alias("node"), (F.col("k") + 1).alias("k")))
        if at.isEmpty():
            break
        all_steps = all_steps.unionByName(at)
        if rounds % every == 0:
            all_steps = cut(all_steps)
    seen = all_steps.join(place, all_steps["node"] == place["node_id"]).groupBy("origin", "destination").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("o"), "x", "y"))).alias("p"))
    line = F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return seen.select("origin", "destination", F.when(F.col("origin") != F.col("destination"), line).alias("line"))


def cutoffs_of(values, weight: str) -> list[tuple[float, float]]:
    """``(as given, in the weight's unit)``, distinct and sorted; raises ``ValueError`` for none, text and numbers not above 0."""
    listed = list(values) if isinstance(values, (list, tuple, set)) else [values]
    if not listed or any(isinstance(v, (str, bool)) or not isinstance(v, (int, float)) or not v > 0 or v == INF for v in listed):
        raise ValueError("cutoffs must be numbers above 0")
    return [(v, in_units(v, weight)) for v in sorted(set(listed))]


def reach(costs: DataFrame, cutoffs: Sequence[tuple[float, float]]) -> DataFrame:
    """``(origin, cutoff, n_nodes)``: the nodes within each cutoff, the origin included."""
    spark = costs.sparkSession
    given = spark.createDataFrame([(float(a), float(b)) for a, b in cutoffs], "cutoff double, _limit double")
    return costs.join(F.broadcast(given), costs["cost"] <= given["_limit"]).groupBy("origin", "cutoff").agg(F.count("*").alias("n_nodes"))


def reach_segments(costs: DataFrame, edges: DataFrame, nodes: DataFrame, weight: str, limit: float) -> DataFrame:
    """``(origin, src, dst, fraction, x1, y1, x2, y2)``: the part of each edge that is reached within ``limit``.

    An edge's part begins at its reached start; edges reached by nothing of their length are left out; an
    edge of weight 0 is reached whole.
    """
    place = lambda a, b, c: nodes.select(F.col("node_id").alias(a), F.col("x").alias(b), F.col("y").alias(c))
    usable = edges.select("src", "dst", F.col(weight).alias("_w")).where(F.col("_w").isNotNull() & (F.col("_w") < INF))
    started = costs.select("origin", F.col("node").alias("src"), "cost").where(F.col("cost") <= limit).join(usable, "src")
    part = F.when(F.col("_w") > 0, F.least((F.lit(limit) - F.col("cost")) / F.col("_w"), F.lit(1.0))).otherwise(1.0)
    drawn = started.withColumn("fraction", part).where("fraction > 0").join(place("src", "x1", "y1"), "src").join(place("dst", "_x", "_y"), "dst")
    return drawn.select("origin", "src", "dst", "fraction", "x1", "y1", (F.col("x1") + F.col("fraction") * (F.col("_x") - F.col("x1"))).alias("x2"), (F.col("y1") + F.col("fraction") * (F.col("_y") - F.col("y1"))).alias("y2"))


def distinct_segments(segments: DataFrame) -> DataFrame:
    """Drawn segments without repeats to the millimetre, in either direction."""
    a = F.struct(F.bround("x1", 3).alias("x"), F.bround("y1", 3).alias("y"))
    b = F.struct(F.bround("x2", 3).alias("x"), F.bround("y2", 3).alias("y"))
    return segments.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b)).dropDuplicates(["origin", "_a", "_b"]).drop("_a", "_b")


def connect_parts(edges: DataFrame, parts: DataFrame, weight: str = "length") -> tuple[DataFrame, DataFrame]:
    """``(connectors, unconnected)``: edges that join each part of an area to the main part, and parts that can't be.

    ``parts(node, part)``: part 1 is the main one.  From all nodes of the main part the nearest node of each
    other part is found forwards and, on the reversed edges, backwards; the edges of both paths are the
    connectors ``(part, src, dst)``.
    """
    main = parts.where("part = 1").select(F.col("node").alias("origin"))
    turned = edges.withColumn("_t", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("_t")).drop("_t")
    both, reached = None, None
    for network, reverse in ((edges, False), (turned, True)):
        costs = cut(travel_costs(network, main, weight, merged=True))
        near = costs.join(parts.where("part > 1"), "node").groupBy("part").agg(F.min(F.struct("cost", "node")).alias("m")).select("part", F.col("m.node").alias("node"))
        reached = near.select("part") if reached is None else reached.intersect(near.select("part"))
        back, at, steps = costs.select("node", "before"), near, None
        while True:
            pairs = cut(at.join(back, "node").where(F.col("before").isNotNull()))
            if pairs.isEmpty():
                break
            ends = pairs.select("part", F.col("node" if reverse else "before").alias("src"), F.col("before" if reverse else "node").alias("dst"))
            steps = ends if steps is None else steps.unionByName(ends)
            at = pairs.select("part", F.col("before").alias("node"))
        if steps is not None:
            both = steps if both is None else both.unionByName(steps)
    missing = parts.where("part > 1").select("part").distinct().join(reached, "part", "left_anti")
    if both is None:
        both = parts.limit(0).select("part", F.col("node").alias("src"), F.col("node").alias("dst"))
    return both.distinct(), missing


def components(edges: DataFrame, every: int = 3) -> DataFrame:
    """``(node, component)``: weakly connected components by the least node, with alternating hooks to larger and smaller neighbours."""
    links = cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).where("u <> v").distinct())
    alone = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    while True:
        # large star: each larger neighbour hangs on the least of the closed neighbourhood
        least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = links.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: all smaller neighbours hang on the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = cut(small)
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        if both.count() == links.count() and both.exceptAll(links).isEmpty():
            break
        links = cut(both)
    root = small.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return alone.join(root, "node", "left").select("node", F.least(F.coalesce("component", "node"), "node").alias("component"))
