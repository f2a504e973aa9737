"""Street tags: lists, road classes, speeds and filters, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Road classes one walks on, which become ``footway``.
WALKABLE = ("footway", "path", "steps", "pedestrian", "living_street", "track", "corridor", "elevator", "bridleway")
#: Free-flow speed in km/h by road class, and of any other class.
FREE_FLOW = {
    "motorway": 100, "motorway_link": 70, "trunk": 80, "trunk_link": 50, "primary": 60, "primary_link": 40, "secondary": 50, "secondary_link": 40,
    "tertiary": 40, "tertiary_link": 30, "residential": 30, "living_street": 15, "unclassified": 30, "service": 20,
}
FALLBACK_SPEED = 30
#: Speeds of modes in km/h (fixed), and seconds lost at the node where an edge arrives.
MODE_SPEED = {"bike": 15.0, "walking": 5.0}
PENALTIES = {
    "driving": {"traffic_signals": 15, "stop": 4, "mini_roundabout": 3, "give_way": 2, "crossing": 3},
    "bike": {"traffic_signals": 8, "stop": 3, "mini_roundabout": 2, "give_way": 1, "crossing": 2},
    "walking": {},
}
CROSSROADS = {"driving": 6, "bike": 3, "walking": 0}
MPH = 1.60934


def flat_list(values: Column) -> Column:
    """A list of texts as ``a;b``; null for none."""
    kept = F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, ";"))


def tokens(text: Column) -> Column:
    """The parts of a ``;`` list that aren't blank."""
    return F.filter(F.transform(F.split(text, ";"), lambda t: F.trim(t)), lambda t: t != "")


def road_class(text: Column) -> Column:
    """The first class of the list; ``footway`` if any class is one to walk on; null for none."""
    parts = tokens(text)
    first = F.when(F.size(parts) > 0, F.element_at(parts, 1))
    return F.when(F.arrays_overlap(parts, F.array(*map(F.lit, WALKABLE))), "footway").otherwise(first)


def speed_kmh(text: Column) -> Column:
    """The highest speed of the list: the first number of each part, miles times 1.60934; null without numbers."""
    part = lambda t: F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double") * F.when(F.lower(t).contains("mph"), MPH).otherwise(1.0)
    return F.array_max(F.transform(F.filter(tokens(text), lambda t: t.rlike(r"\d")), part))


def free_flow_kmh(road: Column) -> Column:
    """The usual speed of a road class."""
    table = F.create_map(*[x for k, v in FREE_FLOW.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(table, F.coalesce(road, F.lit(""))), F.lit(float(FALLBACK_SPEED)))


def travel_seconds(mode: str, length: Column, highway: Column, maxspeed: Column, node_tag: Column, node_role: Column) -> Column:
    """Seconds along an edge: length over speed, and what is lost at the node where it arrives.

    Driving uses the speed limit, or the road class's speed without one; a walkable class has the general
    fallback.  A crossroads without a tag of its own costs the general amount.
    """
    if mode == "driving":
        limit = F.when(~F.isnan(maxspeed) & (maxspeed > 0), maxspeed)
        speed = F.coalesce(limit, free_flow_kmh(road_class(highway)))
    elif mode in MODE_SPEED:
        speed = F.lit(MODE_SPEED[mode])
    else:
        raise ValueError(f"no such mode: {mode!r}")
    lost = F.lit(0.0)
    if PENALTIES[mode]:
        table = F.create_map(*[x for k, v in PENALTIES[mode].items() for x in (F.lit(k), F.lit(float(v)))])
        general = F.when(node_role == "intersection", float(CROSSROADS[mode])).otherwise(0.0)
        lost = F.coalesce(F.try_element_at(table, F.coalesce(node_tag, F.lit(""))), general)
    return length / (speed / 3.6) + lost


def travel_minutes(length: Column, kmh: float) -> Column:
    """Minutes along an edge at one constant speed, the simple measure; null lengths stay null."""
    if not kmh > 0:
        raise ValueError("the speed must be above 0")
    return length.cast("double") / (kmh * 1000 / 60)


_FILTER = re.compile(r'\["([^"]+)"(?:(=|!=|~|!~)"([^"]*)")?\]')


def parse_filter(text: str) -> list[tuple[str, str, str]] | None:
    """``(key, operator, value)`` of each clause ``["k"]``, ``["k"="v"]``, ``!=``, ``~``, ``!~``; None for anything else."""
    clauses, end = [], 0
    for m in _FILTER.finditer(text):
        if m.start() != end:
            return None
        clauses.append((m[1], m[2] or "", m[3] or ""))
        end = m.end()
    return clauses if clauses and end == len(text) else None


def tags_match(tags: Column, clauses: list[tuple[str, str, str]]) -> Column:
    """Whether a tag map passes all clauses; negated clauses pass where the key is missing; ``~`` searches anywhere."""
    passes = F.lit(True)
    for key, op, value in clauses:
        own = F.try_element_at(tags, F.lit(key))
        if op == "":
            test = own.isNotNull()
        elif op == "=":
            test = F.coalesce(own == value, F.lit(False))
        elif op == "!=":
            test = F.coalesce(own != value, F.lit(True))
        elif op == "~":
            test = F.coalesce(own.rlike(value), F.lit(False))
        else:
            test = F.coalesce(~own.rlike(value), F.lit(True))
        passes = passes & test
    return passes


def keep_ways(elements, clauses: list[tuple[str, str, str]]):
    """``(ways, nodes)`` of a street answer: the ways whose tags pass and only the nodes they use."""
    ways = elements.where((F.col("type") == "way") & tags_match(F.col("tags"), clauses))
    used = ways.select(F.explode("nodes").alias("id")).distinct()
    return ways, elements.where("type = 'node'").join(used, "id", "left_semi")
