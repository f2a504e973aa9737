"""Planar predicates as column expressions, against rings that are known when the plan is made.

An area is a list of polygons, each a list of rings of (x, y): the outer one, then holes.  Rings may be
closed or open.  Predicates are closed: a border belongs to the area.  The expression grows with the
area's corners; for areas of many corners use ``railweave.operators.near.regions_holding``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = Sequence[tuple[float, float]]
Area = Sequence[Sequence[Ring]]


def box(x1: float, y1: float, x2: float, y2: float) -> list:
    """The area of an axis-parallel box."""
    return [[[(x1, y1), (x2, y1), (x2, y2), (x1, y2)]]]


def sides(area: Area) -> list[tuple[float, float, float, float]]:
    """All sides of all rings."""
    out = []
    for polygon in area:
        for ring in polygon:
            points = [(float(x), float(y)) for x, y in ring]
            if points[0] == points[-1]:
                points = points[:-1]
            out += [(*p, *q) for p, q in zip(points, [*points[1:], points[0]]) if p != q]
    return out


def _sides_column(area: Area) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(d).alias("d")) for a, b, c, d in sides(area)])


def _cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _on(s: Column, px: Column, py: Column) -> Column:
    within = (px >= F.least(s["a"], s["c"])) & (px <= F.greatest(s["a"], s["c"])) & (py >= F.least(s["b"], s["d"])) & (py <= F.greatest(s["b"], s["d"]))
    return within & (_cross(s["a"], s["b"], s["c"], s["d"], px, py) == 0)


#: Sides up to which a point's test is written out side by side, which compiles; more are an array that is folded.
WRITTEN_OUT = 64


def point_inside(px: Column, py: Column, area: Area) -> Column:
    """Whether a point lies in the area: an odd number of sides to its right, or on a border."""
    listed = sides(area)
    if len(listed) <= WRITTEN_OUT:
        crossed = [F.when(((F.lit(b) > py) != (F.lit(d) > py)) & (px < (py - b) * (c - a) / (d - b) + a), 1).otherwise(0) for a, b, c, d in listed if b != d]
        on = [(px >= min(a, c)) & (px <= max(a, c)) & (py >= min(b, d)) & (py <= max(b, d)) & ((py - b) * (c - a) == (px - a) * (d - b)) for a, b, c, d in listed]
        return (sum(crossed, F.lit(0)) % 2 == 1) | reduce(or_, on)
    lines = _sides_column(area)
    over = lambda s: ((s["b"] > py) != (s["d"] > py)) & (px < (s["c"] - s["a"]) * (py - s["b"]) / F.when(s["d"] != s["b"], s["d"] - s["b"]) + s["a"])
    odd = F.size(F.filter(lines, lambda s: F.coalesce(over(s), F.lit(False)))) % 2 == 1
    return odd | F.exists(lines, lambda s: _on(s, px, py))


def segment_meets(x1: Column, y1: Column, x2: Column, y2: Column, area: Area) -> Column:
    """Whether a straight line from one point to another meets the area: an end inside, or a side crossed or touched."""

    def crosses(s: Column) -> Column:
        a = _cross(x1, y1, x2, y2, s["a"], s["b"])
        b = _cross(x1, y1, x2, y2, s["c"], s["d"])
        c = _cross(s["a"], s["b"], s["c"], s["d"], x1, y1)
        d = _cross(s["a"], s["b"], s["c"], s["d"], x2, y2)
        proper = (((a > 0) & (b < 0)) | ((a < 0) & (b > 0))) & (((c > 0) & (d < 0)) | ((c < 0) & (d > 0)))
        line = F.struct(x1.alias("a"), y1.alias("b"), x2.alias("c"), y2.alias("d"))
        touch = _on(s, x1, y1) | _on(s, x2, y2) | _on(line, s["a"], s["b"]) | _on(line, s["c"], s["d"])
        return proper | touch

    return point_inside(x1, y1, area) | F.exists(_sides_column(area), crosses)


def distance_to(px: Column, py: Column, area: Area) -> Column:
    """Distance of a point from the area; 0 inside.  ``distance_to(...) <= b`` is the area widened by ``b``."""

    def to_side(s: Column) -> Column:
        dx, dy = s["c"] - s["a"], s["d"] - s["b"]
        t = F.greatest(F.least(((px - s["a"]) * dx + (py - s["b"]) * dy) / (dx * dx + dy * dy), F.lit(1.0)), F.lit(0.0))
        return F.hypot(px - s["a"] - t * dx, py - s["b"] - t * dy)

    return F.when(point_inside(px, py, area), F.lit(0.0)).otherwise(F.array_min(F.transform(_sides_column(area), to_side)))


def planar_length(points: Column) -> Column:
    """The length of a line ``array<struct<x, y>>``."""
    pairs = F.arrays_zip(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))).alias("p"), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))).alias("q"))
    return F.aggregate(pairs, F.lit(0.0), lambda t, s: t + F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]))


def wkt_line(points: Column) -> Column:
    """``LINESTRING (...)`` of a line."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit(")"))
