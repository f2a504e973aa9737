"""Points near other points, and regions that hold points.

A sample of the points, a few for each leaf, drives a quadtree whose leaves hold about as many points each.  Every
point goes to the leaf that holds it and, near a border, is copied to the neighbouring leaves within
the distance.  In each leaf an R-tree is bulk-loaded (sort-tile-recursive) and probed; candidates are
refined by exact geometry.  A pair is reported in one leaf only: the one holding the reference point,
which is the position of the point with the smaller id.  Leaves that are denser than the sample said
are split into blocks of points, and pairs of blocks are separate tasks, so that no task is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.scale import cut, lookup_join

#: The least size of the sample that shapes the quadtree and the least points of it in a full leaf: with these the sample
#: grows with the number of leaves (16 bytes a point), so that leaves hold as many points whatever the size.
SAMPLE, IN_LEAF = 50_000, 16
#: The points a leaf should hold, and those of a block.
LEAF, BLOCK = 20_000, 30_000
#: The most corner points of regions that are sent to the tasks.
MAX_CORNERS = 500_000


class QuadTree:
    """Leaves over the plane, in arrays: a node's children are four successive entries of ``first``."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray, per_leaf: int, least_side: float) -> None:
        lo = (xs.min(), ys.min()) if len(xs) else (0.0, 0.0)
        side = max((np.ptp(xs), np.ptp(ys)), default=0.0) if len(xs) else 0.0
        self.x0, self.y0, self.side = float(lo[0]), float(lo[1]), float(max(side, least_side, 1e-9))
        self.first, self.leaf, self.n_leaves = [-1], [-1], 0
        todo = [(0, np.arange(len(xs)), self.x0, self.y0, self.side)]
        while todo:
            node, members, x, y, s = todo.pop()
            if len(members) <= per_leaf or s / 2 < least_side:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            self.first[node] = len(self.first)
            self.first += [-1] * 4
            self.leaf += [-1] * 4
            half = s / 2
            quarter = (xs[members] >= x + half) + 2 * (ys[members] >= y + half)
            for q in range(4):
                todo.append((self.first[node] + q, members[quarter == q], x + half * (q % 2), y + half * (q // 2), half))
        self.first, self.leaf = np.array(self.first), np.array(self.leaf)

    def home(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """The leaf of each point; points outside the sampled square belong to the nearest border leaf."""
        node, x, y = np.zeros(len(xs), int), np.full(len(xs), self.x0), np.full(len(xs), self.y0)
        s = self.side
        while True:
            inner = self.first[node] >= 0
            if not inner.any():
                return self.leaf[node]
            s /= 2
            right, upper = xs >= x + s, ys >= y + s
            x, y = np.where(inner & right, x + s, x), np.where(inner & upper, y + s, y)
            node = np.where(inner, self.first[node] + right + 2 * upper, node)

    def touched(self, x1: float, y1: float, x2: float, y2: float) -> list[int]:
        """The leaves that a box meets; the outermost leaves reach to infinity."""
        found, todo = [], [(0, self.x0, self.y0, self.side)]
        while todo:
            node, x, y, s = todo.pop()
            if self.first[node] < 0:
                found.append(int(self.leaf[node]))
                continue
            half = s / 2
            for q in range(4):
                if (x2 >= x + half if q % 2 else x1 < x + half) and (y2 >= y + half if q // 2 else y1 < y + half):
                    todo.append((self.first[node] + q, x + half * (q % 2), y + half * (q // 2), half))
        return found


class RTree:
    """A static R-tree of boxes, bulk-loaded by sort-tile-recursive packing."""

    def __init__(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, fan: int = 16) -> None:
        n = len(x1)
        order = np.argsort(x1 + x2, kind="stable")
        slices = max(1, int(np.ceil(np.sqrt(n / fan)))) if n else 1
        strip = max(1, int(np.ceil(n / slices)))
        order = order[np.lexsort(((y1 + y2)[order], np.arange(n) // strip))]
        self.items, self.fan = order, fan
        self.levels = [(x1[order], y1[order], x2[order], y2[order])]
        while len(self.levels[-1][0]) > fan:
            a, b, c, d = self.levels[-1]
            cuts = np.arange(0, len(a), fan)
            self.levels.append((np.minimum.reduceat(a, cuts), np.minimum.reduceat(b, cuts), np.maximum.reduceat(c, cuts), np.maximum.reduceat(d, cuts)))

    def probe(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, item) whose boxes meet, level by level for all queries at once."""
        if not len(self.items) or not len(x1):
            return np.zeros(0, int), np.zeros(0, int)
        top = len(self.levels[-1][0])
        query, entry = np.repeat(np.arange(len(x1)), top), np.tile(np.arange(top), len(x1))
        for depth in range(len(self.levels) - 1, -1, -1):
            a, b, c, d = self.levels[depth]
            hit = (a[entry] <= x2[query]) & (c[entry] >= x1[query]) & (b[entry] <= y2[query]) & (d[entry] >= y1[query])
            query, entry = query[hit], entry[hit]
            if depth:
                below = len(self.levels[depth - 1][0])
                query = np.repeat(query, self.fan)
                entry = (entry[:, None] * self.fan + np.arange(self.fan)).ravel()
                query, entry = query[entry < below], entry[entry < below]
        return query, self.items[entry]


def points(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """``(id, x, y)``: the distinct positions of ``df`` with an id and two finite coordinates."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in (px, py)]
    return df.where(F.col(key).isNotNull() & finite[0] & finite[1]).select(F.col(key).alias("id"), (px + 0.0).alias("x"), (py + 0.0).alias("y")).distinct()


def sampled_tree(pts: DataFrame, n: int, least_side: float, sample: int = SAMPLE, leaf: int = LEAF, seed: int = 17) -> QuadTree:
    """A quadtree whose leaves hold about ``leaf`` of all ``n`` points, shaped by ``sample`` of them or ``IN_LEAF`` for each leaf."""
    sample = max(sample, IN_LEAF * n // leaf)
    share = min(1.0, sample / max(n, 1))
    picked = (pts if share == 1 else pts.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) < share * (1 << 40))).select("x", "y").toPandas()
    return QuadTree(picked["x"].to_numpy(float), picked["y"].to_numpy(float), max(IN_LEAF, int(leaf * share)), least_side)


def _placed(pts: DataFrame, tree: QuadTree, reach: float) -> DataFrame:
    """``pts(id, x, y)`` with ``leaf`` and ``own``: each in its leaf, and a copy in each other leaf within ``reach`` of it.

    No leaf may be narrower than twice ``reach``.
    """
    kind = pts.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xs, ys = b["x"].to_numpy(float), b["y"].to_numpy(float)
            home = tree.home(xs, ys)
            yield b.assign(leaf=home, own=True)
            if not reach:
                continue
            # each leaf that meets a point's square holds a corner, side or middle of it
            seen = [home]
            for i, j in ((-1, -1), (-1, 1), (1, -1), (1, 1), (-1, 0), (1, 0), (0, -1), (0, 1)):
                corner = tree.home(xs + i * reach, ys + j * reach)
                new = np.logical_and.reduce([corner != s for s in seen])
                if new.any():
                    yield b[new].assign(leaf=corner[new], own=False)
                    seen.append(corner)

    return pts.mapInPandas(placed, f"id {kind}, x double, y double, leaf long, own boolean")


def nearest(pts: DataFrame, others: DataFrame, distance: float, *, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``(id, other, distance)``: for each of ``pts(id, x, y)`` the nearest of ``others(id, x, y)`` at most ``distance`` away.

    Of equally near ones the smaller id; points without one have no row.  Points and others meet in the leaves
    of a quadtree over the others, in blocks where a leaf is full; in a block an R-tree is probed with boxes
    that grow until they hold something, so that dense places aren't compared as a whole.
    """
    others = cut(points(others, "id", "x", "y"))
    tree = sampled_tree(others, others.count(), max(2 * distance, 1e-9), sample, leaf)
    left, right = _placed(points(pts, "id", "x", "y"), tree, 0.0).drop("own"), _placed(others, tree, distance * (1 + 1e-9)).drop("own")
    full = lambda df, n: df.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias(n))
    blocks = cut(full(left, "pb").join(full(right, "ob"), "leaf"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id", "x", "y"), F.col(n))
    left = lookup_join(left, blocks, ["leaf"], "inner").withColumn("p", part("pb")).withColumn("o", each("ob")).drop("pb", "ob")
    right = lookup_join(right, blocks, ["leaf"], "inner").withColumn("o", part("ob")).withColumn("p", each("pb")).drop("pb", "ob")
    kinds = [df.schema["id"].dataType.simpleString() for df in (left, right)]

    def probed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids = b["id"].to_numpy()
        xs, ys, ox, oy = a["x"].to_numpy(float), a["y"].to_numpy(float), b["x"].to_numpy(float), b["y"].to_numpy(float)
        best, least = np.full(len(a), -1), np.full(len(a), np.inf)
        boxes = RTree(ox, oy, ox, oy)
        side = max(np.ptp(ox), np.ptp(oy)) if len(b) else 0.0
        # about one other in the first box if they were spread evenly
        r, todo = min(distance, max(side / max(np.sqrt(len(b)), 1.0), distance / 4096)), np.arange(len(a))
        while len(todo) and len(b):
            for k in range(0, len(todo), 4096):
                own = todo[k : k + 4096]
                q, i = boxes.probe(xs[own] - r, ys[own] - r, xs[own] + r, ys[own] + r)
                q = own[q]
                d = np.hypot(ox[i] - xs[q], oy[i] - ys[q])
                near = d <= min(r, distance)
                q, i, d = q[near], i[near], d[near]
                order = np.lexsort((ids[i], d, q))
                first = order[np.r_[True, q[order][1:] != q[order][:-1]]] if len(order) else order
                best[q[first]], least[q[first]] = i[first], d[first]
            if r >= distance:
                break
            todo, r = todo[best[todo] < 0], min(2 * r, distance)
        found = best >= 0
        return pd.DataFrame({"id": a["id"].to_numpy()[found], "other": ids[best[found]], "distance": least[found]})

    key = ["leaf", "p", "o"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(probed, f"id {kinds[0]}, other {kinds[1]}, distance double")
    return met.groupBy("id").agg(F.min(F.struct("distance", "other")).alias("m")).select("id", "m.other", "m.distance")


def near_pairs(df: DataFrame, key: str, x: str, y: str, distance: float, *, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``(id_a, id_b)``, smaller first: all pairs of different ids at most ``distance`` apart, each once.

    Rows lacking an id or a finite coordinate are in no pair; repeated rows count once; an id at several
    positions is near whatever any of them is near; an empty table gives no pair.  Other columns are ignored.
    """
    if not distance >= 0:
        raise ValueError("distance must not be negative")
    pts = cut(points(df, key, x, y))
    kind = pts.schema["id"].dataType.simpleString()
    tree = sampled_tree(pts, pts.count(), max(2 * distance, 1e-9), sample, leaf)
    reach = distance * (1 + 1e-9)

    rows = _placed(pts, tree, reach)
    # leaves fuller than the sample said are split into blocks; pairs of blocks are tasks of their own
    counts = cut(rows.groupBy("leaf").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block)).drop("n"))
    rows = lookup_join(rows, counts, ["leaf"]).withColumn("b", F.pmod(F.xxhash64("id", "x", "y"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("b1", F.least("b", "other")).withColumn("b2", F.greatest("b", "other"))

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        xs, ys, ids, own = g["x"].to_numpy(float), g["y"].to_numpy(float), g["id"].to_numpy(), g["own"].to_numpy(bool)
        first, second = g["b"].to_numpy() == g["b1"].to_numpy(), g["b"].to_numpy() == g["b2"].to_numpy()
        left, right = np.flatnonzero(first), np.flatnonzero(second)
        tree_ = RTree(xs[right], ys[right], xs[right], ys[right])
        out: list[pd.DataFrame] = []
        for k in range(0, len(left), 4096):
            part = left[k : k + 4096]
            q, i = tree_.probe(xs[part] - reach, ys[part] - reach, xs[part] + reach, ys[part] + reach)
            a, b = part[q], right[i]
            swap = ids[a] > ids[b]
            lo, hi = np.where(swap, b, a), np.where(swap, a, b)
            fits = (ids[lo] < ids[hi]) & own[lo] & (np.hypot(xs[lo] - xs[hi], ys[lo] - ys[hi]) <= distance)
            out.append(pd.DataFrame({"id_a": ids[lo[fits]], "id_b": ids[hi[fits]]}).drop_duplicates())
        return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"id_a": ids[:0], "id_b": ids[:0]})

    pairs = rows.select("leaf", "b1", "b2", "id", "x", "y", "own", "b").groupBy("leaf", "b1", "b2").applyInPandas(joined, f"id_a {kind}, id_b {kind}")
    # only an id at several positions can meet the same id twice; the distinct is cheap beside the join
    return pairs.distinct()


def inside(px: np.ndarray, py: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether each point lies in a closed ring; its border counts as inside."""
    x1, y1, x2, y2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    odd, border = np.zeros(len(px), bool), np.zeros(len(px), bool)
    for a, b, c, d in zip(x1, y1, x2, y2):
        cross = (c - a) * (py - b) - (d - b) * (px - a)
        border |= (cross == 0) & (np.minimum(a, c) <= px) & (px <= np.maximum(a, c)) & (np.minimum(b, d) <= py) & (py <= np.maximum(b, d))
        over = (b > py) != (d > py)
        if d != b:
            odd ^= over & (px < (c - a) * (py - b) / (d - b) + a)
    return odd | border


def _shapes(rings) -> list[tuple]:
    """``(region, corners)`` of each region and ring, closed."""
    return [(region, np.array([(p["x"], p["y"]) for p in [*ring, ring[0]]], float)) for region, ring in rings]


def _probed(shapes: Sequence[tuple], b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The points of ``b`` in each shape: candidates by an R-tree of boxes, then the exact test."""
    box = np.array([[*s.min(axis=0), *s.max(axis=0)] for _, s in shapes], float).reshape(-1, 4)
    xs, ys = b["x"].to_numpy(float), b["y"].to_numpy(float)
    q, i = RTree(*box.T).probe(xs, ys, xs, ys)
    for r in np.unique(i):
        own = q[i == r]
        own = own[inside(xs[own], ys[own], shapes[r][1])]
        yield pd.DataFrame({"region": [shapes[r][0]] * len(own), "id": b["id"].to_numpy()[own]})


def regions_holding(df: DataFrame, key: str, x: str, y: str, regions: DataFrame, region_key: str, ring: str, *, max_corners: int = MAX_CORNERS) -> DataFrame:
    """``(region, id)``: each region with each distinct id that has a position in it; borders belong to the region.

    ``ring``: ``array<struct<x, y>>``, closed or not.  The regions' corners are counted: up to ``max_corners``
    they are sent to the tasks, and points aren't shuffled; beyond, both meet in a quadtree's leaves.  Rows lacking an id
    or a finite coordinate and rings of under three corners hold nothing.
    """
    pts = points(df, key, x, y)
    kind = pts.schema["id"].dataType.simpleString()
    clean = regions.where(F.col(region_key).isNotNull() & (F.size(ring) >= 3)).select(F.col(region_key).alias("region"), F.col(ring).alias("ring"))
    region_kind = clean.schema["region"].dataType.simpleString()
    corners = clean.agg(F.coalesce(F.sum(F.size("ring")), F.lit(0))).first()[0]

    def held(rows: Sequence) -> DataFrame:
        shapes = _shapes((r["region"], r["ring"]) for r in rows)

        def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield from _probed(shapes, b)

        return pts.mapInPandas(probed, f"region {region_kind}, id {kind}")

    if corners <= max_corners:
        return held(clean.collect()).distinct()

    # too many to be sent everywhere: regions and points meet in the quadtree's leaves, in blocks of each
    pts = cut(pts)
    tree = sampled_tree(pts, pts.count(), 1e-9)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=tree.home(b["x"].to_numpy(float), b["y"].to_numpy(float)))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for region, ring_ in zip(b["region"], b["ring"]):
                px, py = [p["x"] for p in ring_], [p["y"] for p in ring_]
                leaves = tree.touched(min(px), min(py), max(px), max(py))
                for k in range(0, len(leaves), 1_000):
                    yield pd.DataFrame({"region": [region] * len(leaves[k : k + 1_000]), "leaf": leaves[k : k + 1_000], "ring": [ring_] * len(leaves[k : k + 1_000])})

    at = pts.mapInPandas(homes, f"id {kind}, x double, y double, leaf long")
    shapes = clean.mapInPandas(met, f"region {region_kind}, leaf long, ring array<struct<x:double,y:double>>")
    full = at.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("pb"))
    wide = shapes.groupBy("leaf").agg(F.ceil(F.sum(F.size("ring")) / max_corners).alias("rb"))
    blocks = cut(full.join(wide, "leaf"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = lookup_join(at, blocks, ["leaf"], "inner").withColumn("p", F.pmod(F.xxhash64("id", "x", "y"), F.col("pb"))).withColumn("r", each("rb")).drop("pb", "rb")
    right = lookup_join(shapes, blocks, ["leaf"], "inner").withColumn("r", F.pmod(F.xxhash64("region"), F.col("rb"))).withColumn("p", each("pb")).drop("pb", "rb")

    def both(points_: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = list(_probed(_shapes(zip(rows["region"], rows["ring"])), points_)) if len(rows) and len(points_) else []
        return pd.concat(out) if out else pd.DataFrame({"region": rows["region"][:0], "id": points_["id"][:0]})

    key = ["leaf", "p", "r"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(both, f"region {region_kind}, id {kind}").distinct()
