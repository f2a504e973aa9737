"""Study areas: the cascading name matcher, overlaps with municipalities and shares of provinces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.functions.polygons import clip_convex, shape_area, union
from railweave.functions.text import edit_similarity, municipality_code, name_parts, normal_name, province_code, province_of, typo_distance
from railweave.scale import cut

#: Least similarity of a fuzzy match, least share of a province and of a municipality.
FUZZY, LEAST_SHARE = 0.8, 0.05
STEPS = ("exact", "part", "words", "substring", "fuzzy")


class AmbiguousAreaError(ValueError):
    """A name that means several places; ``candidates`` lists them."""

    def __init__(self, name: str, candidates: Sequence[str]) -> None:
        self.candidates = list(candidates)
        listed = ", ".join(self.candidates[:15]) + (f" and {len(self.candidates) - 15} more" if len(self.candidates) > 15 else "")
        super().__init__(f"{name!r} may mean {listed}; give a province or a code")


def step_of(typed: Column, whole: Column, parts: Column) -> Column:
    """The first cascade step (1 to 4) by which a normal name fits a list entry; null if none does."""
    padded = F.concat(F.lit(" "), typed, F.lit(" "))
    entry = F.concat(F.lit(" "), whole, F.lit(" "))
    first = F.try_element_at(F.filter(parts, lambda p: p != whole), F.lit(1))
    return (
        F.when((typed == whole) | (typed == first), 1)
        .when(F.array_contains(parts, typed), 2)
        .when(F.instr(entry, padded) > 0, 3)
        .when(F.instr(whole, typed) > 0, 4)
    )


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of ``text``."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))


def _pairs(text: Column) -> Column:
    """The pairs of characters of ``text``, its ends included, each with its how-manieth occurrence."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda q: q == p)).cast("string")))


def match_cascade(names: DataFrame, reference: DataFrame, *, name: str = "area_name", reference_name: str = "nameunit", code: str = "natcode", fuzzy: float = FUZZY) -> DataFrame:
    """``(name, step, n_codes, code)`` for each distinct name: the first step of the cascade that finds entries.

    Steps: equal, equal to a part, whole words within, substring, best swap-aware similarity of at least
    ``fuzzy`` with at most max(2, 30 % of the longer length) edits.  ``code`` is null if the step's entries
    have several codes.  ``fuzzy`` above 1 leaves the last step out.

    No step compares all names with all entries: the first three are equalities with what an entry or runs
    of its words say, a substring is looked for where its first three characters stand, and two texts within
    d edits share all but 3 d of their pairs of characters (a swap touches three), so only those are compared.
    """
    if fuzzy < 0.7:
        raise ValueError("fuzzy must be at least 0.7: below, texts may share no pair of characters")
    typed = cut(names.where(F.col(name).isNotNull()).select(name).distinct().withColumn("_t", normal_name(F.col(name))).where("_t <> ''"))
    listed = cut(reference.where(F.col(reference_name).isNotNull()).select(F.col(code).alias("code"), normal_name(F.col(reference_name)).alias("_w"), name_parts(F.col(reference_name)).alias("_p")).distinct())
    first = F.try_element_at(F.filter("_p", lambda p: p != F.col("_w")), F.lit(1))
    parts = F.split("_w", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda n: F.array_join(F.slice(parts, i, n), " "))))
    said = [
        listed.select("code", F.lit(1).alias("step"), F.explode(F.array_distinct(F.array_compact(F.array(F.col("_w"), first)))).alias("_t")),
        listed.select("code", F.lit(2).alias("step"), F.explode("_p").alias("_t")),
        listed.select("code", F.lit(3).alias("step"), F.explode(F.array_distinct(runs)).alias("_t")),
    ]
    hits = typed.join(said[0].unionByName(said[1]).unionByName(said[2]), "_t")
    found = cut(_first_step(hits, name))
    rest = typed.join(found.select(name), name, "left_anti")
    entries = listed.select("code", "_w")
    within = []
    for size, own in ((1, F.length("_t") == 1), (2, F.length("_t") == 2), (3, F.length("_t") >= 3)):
        grams = entries.select("code", "_w", F.explode(_grams(F.col("_w"), size)).alias("_g"))
        within.append(rest.where(own).withColumn("_g", F.substring("_t", 1, size)).join(grams, "_g").where(F.instr(F.col("_w"), F.col("_t")) > 0).select(name, "code", F.lit(4).alias("step")))
    found = cut(found.unionByName(_first_step(within[0].unionByName(within[1]).unionByName(within[2]), name)))
    if fuzzy > 1:
        return found
    rest = typed.join(found.select(name), name, "left_anti")
    longer = F.greatest(F.length("_t"), F.length("part"))
    # the similarity asked for bounds the edits too
    most = F.least(F.greatest(F.lit(2), F.bround(0.3 * longer).cast("int")), F.floor((1 - fuzzy) * longer + 1e-9).cast("int"))
    each = listed.select(F.explode("_p").alias("part")).distinct()
    one = rest.select("_t").distinct().select("_t", F.explode(_pairs(F.col("_t"))).alias("_g"))
    two = each.select("part", F.explode(_pairs(F.col("part"))).alias("_g"))
    close = F.abs(F.length("_t") - F.length("part")) <= most
    shared = one.join(two, "_g").where(close).groupBy("_t", "part").agg(F.count("*").alias("_n"))
    near = shared.where(F.col("_n") >= longer + 1 - 3 * most)
    near = near.where(F.levenshtein("_t", "part") <= 2 * most).withColumn("d", typo_distance(F.col("_t"), F.col("part"), most))
    near = near.where(F.col("d") <= most).withColumn("s", 1 - F.col("d") / longer).where(F.col("s") >= fuzzy)
    top = near.groupBy("_t").agg(F.max("s").alias("_top"))
    best = near.join(top, "_t").where(F.col("s") > F.col("_top") - 1e-9).join(listed.select("code", F.explode("_p").alias("part")), "part")
    return found.unionByName(_first_step(rest.join(best, "_t").select(name, "code", F.lit(5).alias("step")), name))


def _first_step(hits: DataFrame, name: str) -> DataFrame:
    per = hits.groupBy(name, "step").agg(F.count_distinct("code").cast("long").alias("n_codes"), F.min("code").alias("code"))
    first = per.groupBy(name).agg(F.min(F.struct("step", "n_codes", "code")).alias("m")).select(name, "m.*")
    return first.select(name, "step", "n_codes", F.when(F.col("n_codes") == 1, F.col("code")).alias("code"))


def find_area(reference: DataFrame, name: str | None = None, *, area_code: str | None = None, province: int | str | None = None, reference_name: str = "nameunit", code: str = "natcode", level: str = "natlevname"):
    """``(row, step)`` of the one municipality meant; raises ``ValueError`` if none is, ``AmbiguousAreaError`` for several.

    ``area_code`` (whole, or the last five digits) bypasses names; ``province`` (code or name) filters first.
    """
    province = None if province is None else province_code(province)
    rows = reference
    if level in reference.columns:
        rows = rows.where(F.col(level) == "Municipio")
    if province is not None:
        rows = rows.where(province_of(F.col(code)) == province)
        if rows.isEmpty():
            raise ValueError(f"no municipality in province {province}")
    label = F.concat(F.col(reference_name), F.lit(" ("), F.coalesce(province_of(F.col(code)).cast("string"), F.lit("?")), F.lit(", "), F.col(code), F.lit(")"))
    if area_code is not None:
        exact = rows.where(F.col(code) == area_code)
        if exact.isEmpty() and len(area_code) == 5:
            exact = rows.where((F.length(code) >= 8) & (municipality_code(F.col(code)) == area_code))
        hits, step = exact, "code"
    else:
        asked = rows.sparkSession.createDataFrame([(name,)], "area_name string")
        matched = match_cascade(asked, rows, reference_name=reference_name, code=code).first()
        if matched is None:
            raise ValueError(f"no municipality is called like {name!r}")
        step = STEPS[matched["step"] - 1]
        if matched["n_codes"] > 1:
            typed = normal_name(F.lit(name))
            fits = step_of(typed, normal_name(F.col(reference_name)), name_parts(F.col(reference_name))) == matched["step"]
            listed = rows.where(fits) if matched["step"] < 5 else rows.where(edit_similarity(typed, normal_name(F.col(reference_name))) >= FUZZY - 0.15)
            raise AmbiguousAreaError(name, [r[0] for r in listed.select(label).distinct().limit(50).collect()])
        hits = rows.where(F.col(code) == matched["code"])
    found = hits.limit(1).collect()
    if not found:
        raise ValueError(f"no municipality has the code {area_code!r}")
    return found[0], step


def _crossings(sides_a: np.ndarray, sides_b: np.ndarray) -> list[float]:
    """The x of all places where a side of one meets a side of the other."""
    out: list[float] = []
    for x1, y1, x2, y2 in sides_a:
        dx, dy = x2 - x1, y2 - y1
        ex, ey = sides_b[:, 2] - sides_b[:, 0], sides_b[:, 3] - sides_b[:, 1]
        den = dx * ey - dy * ex
        with np.errstate(all="ignore"):
            t = ((sides_b[:, 0] - x1) * ey - (sides_b[:, 1] - y1) * ex) / den
            u = ((sides_b[:, 0] - x1) * dy - (sides_b[:, 1] - y1) * dx) / den
        hit = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        out += list(x1 + t[hit] * dx)
    return out


def _spans(sides_: np.ndarray, a: float, b: float) -> list[tuple[float, float, float, float]]:
    """The trapezoids of a shape between two verticals without a corner between: (low at a, low at b, high at a, high at b)."""
    middle = (a + b) / 2
    lo, hi = np.minimum(sides_[:, 0], sides_[:, 2]), np.maximum(sides_[:, 0], sides_[:, 2])
    own = sides_[(lo < middle) & (hi > middle)]
    slope = (own[:, 3] - own[:, 1]) / (own[:, 2] - own[:, 0])
    at = lambda x: own[:, 1] + (x - own[:, 0]) * slope
    order = np.argsort(at(middle))
    ya, yb = at(a)[order], at(b)[order]
    return [(ya[i], yb[i], ya[i + 1], yb[i + 1]) for i in range(0, len(ya) - 1, 2)]


def overlap_area(one: Sequence[Sequence], other: Sequence[Sequence]) -> float:
    """The area that two shapes share, each a list of rings under the even-odd rule, by vertical slabs."""

    def lines(rings):
        out = []
        for ring in rings:
            p = np.asarray(ring, float)
            q = np.vstack([p[1:], p[:1]]) if not np.array_equal(p[0], p[-1]) else p[1:]
            p = p if len(q) == len(p) else p[:-1]
            out.append(np.hstack([p, q]))
        return np.vstack(out)

    a, b = lines(one), lines(other)
    left, right = max(a[:, 0].min(), b[:, 0].min()), min(a[:, 0].max(), b[:, 0].max())
    if left >= right:
        return 0.0
    xs = np.unique(np.r_[a[:, 0], b[:, 0], _crossings(a, b), _crossings(a, a), _crossings(b, b), left, right])
    xs = xs[(xs >= left) & (xs <= right)]
    total = 0.0
    for x1, x2 in zip(xs[:-1], xs[1:]):
        if x2 - x1 <= 0:
            continue
        for la, lb, ha, hb in _spans(a, x1, x2):
            for ma, mb, ga, gb in _spans(b, x1, x2):
                start = max(0.0, min(ha, ga) - max(la, ma))
                end = max(0.0, min(hb, gb) - max(lb, mb))
                total += (start + end) / 2 * (x2 - x1)
    return total


def _is_box(rings: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a shape is one ring around the four corners of its box, with or without the first again at the end."""
    r = rings[0]
    at = lambda i: F.try_element_at(r, F.lit(i))
    turns = lambda i: (at(i)["x"] == at(i + 1)["x"]) != (at(i)["y"] == at(i + 1)["y"])
    corner = lambda p: p["x"].isin(x1, x2) & p["y"].isin(y1, y2)
    closed = (F.size(r) == 4) | ((F.size(r) == 5) & (at(5) == at(1)))
    return (F.size(rings) == 1) & closed & (F.size(F.array_distinct(r)) == 4) & F.forall(r, corner) & turns(1) & turns(2) & turns(3)


def overlaps(areas: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    """``(area_id, region_id, shared, area_size, region_size)`` of all pairs that share some area.

    Both tables hold ``(id, rings array<array<struct<x, y>>>)``.  Boxes meet in a grid of ``cell``; a pair is
    judged in the cell of the lower left corner of its boxes' overlap, so once.
    """

    def boxed(df: DataFrame, name: str) -> DataFrame:
        xs, ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["x"]))), F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["y"])))
        box = df.select(F.col("id").alias(name), F.col("rings").alias(f"{name}_r"), F.array_min(xs).alias(f"{name}_1"), F.array_min(ys).alias(f"{name}_2"), F.array_max(xs).alias(f"{name}_3"), F.array_max(ys).alias(f"{name}_4"))
        box = box.withColumn(f"{name}_b", F.coalesce(_is_box(F.col(f"{name}_r"), *[F.col(f"{name}_{i}") for i in (1, 2, 3, 4)]), F.lit(False)))
        steps = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        return box.withColumn("cx", F.explode(steps(f"{name}_1", f"{name}_3"))).withColumn("cy", F.explode(steps(f"{name}_2", f"{name}_4")))

    pairs = boxed(areas, "a").join(boxed(regions, "b"), ["cx", "cy"])
    x, y = F.greatest("a_1", "b_1"), F.greatest("a_2", "b_2")
    meets = (x <= F.least("a_3", "b_3")) & (y <= F.least("a_4", "b_4"))
    own = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
    # rectangles along the axes, which are their own boxes, are judged by their boxes without leaving the JVM
    both = F.col("a_b") & F.col("b_b")
    side = lambda i, j: F.greatest(F.least(f"a_{j}", f"b_{j}") - F.greatest(f"a_{i}", f"b_{i}"), F.lit(0.0))
    size = lambda n: (F.col(f"{n}_3") - F.col(f"{n}_1")) * (F.col(f"{n}_4") - F.col(f"{n}_2"))
    pairs = pairs.where(meets & own).select(
        F.col("a").alias("area_id"), F.col("b").alias("region_id"), *[F.when(both, v).alias(n) for n, v in (("shared", side(1, 3) * side(2, 4)), ("area_size", size("a")), ("region_size", size("b")))], *[F.when(~both, F.col(c)).alias(c) for c in ("a_r", "b_r")]
    )
    pairs = pairs.where(F.col("shared").isNull() | (F.col("shared") > 0))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = lambda rings: [[(p["x"], p["y"]) for p in r] for r in rings]
        for g in batches:
            rest = g["shared"].isna()
            if rest.any():
                one, two = [shape(r) for r in g.loc[rest, "a_r"]], [shape(r) for r in g.loc[rest, "b_r"]]
                g.loc[rest, "shared"] = [overlap_area(p, q) for p, q in zip(one, two)]
                g.loc[rest, "area_size"], g.loc[rest, "region_size"] = [overlap_area(p, p) for p in one], [overlap_area(q, q) for q in two]
            yield g.loc[g["shared"] > 0, ["area_id", "region_id", "shared", "area_size", "region_size"]]

    a, b = areas.schema["id"].dataType.simpleString(), regions.schema["id"].dataType.simpleString()
    return pairs.mapInPandas(judged, f"area_id {a}, region_id {b}, shared double, area_size double, region_size double")


def province_shares(shared: DataFrame, province: Column, least: float = LEAST_SHARE) -> DataFrame:
    """``(area_id, province, share)``: provinces holding at least ``least`` of an area, by falling share and code."""
    by = shared.withColumn("province", province).groupBy("area_id", "province").agg(F.sum("shared").alias("s"), F.max("area_size").alias("t"))
    return by.withColumn("share", F.col("s") / F.col("t")).where(F.col("share") >= least).select("area_id", "province", "share").orderBy("area_id", F.desc(F.round("share", 6)), "province")


def municipalities_in(shared: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``(area_id, region_id)``: regions of which at least ``least`` lies in the area, or which make up ``least`` of it."""
    enough = (F.col("shared") / F.col("region_size") >= least) | (F.col("shared") / F.col("area_size") >= least)
    return shared.where(enough).select("area_id", "region_id").orderBy("area_id", "region_id")


def dissolved(shapes: DataFrame, key: str) -> DataFrame:
    """``(key, rings array<array<struct<x, y>>>, area)``: the union of the shapes ``(key, rings)`` of each key.

    Outer rings run counter-clockwise, holes clockwise.  What makes up one key is united in one task, so a
    key should be a bounded place; ``tiled_union`` does it for any number of street stretches.
    """
    kind = shapes.schema[key].dataType.simpleString()

    def united(g: pd.DataFrame) -> pd.DataFrame:
        rings = union([[[(p["x"], p["y"]) for p in r] for r in rings] for rings in g["rings"]])
        made = [[{"x": x, "y": y} for x, y in r] for r in rings]
        return pd.DataFrame({key: g[key].iloc[:1], "rings": [made], "area": [shape_area(rings)]})

    return shapes.select(key, "rings").groupBy(key).applyInPandas(united, f"`{key}` {kind}, rings array<array<struct<x:double,y:double>>>, area double")


def tiled_union(segments: DataFrame, keys: Sequence[str], radius: float, tile: float) -> DataFrame:
    """``(keys..., tx, ty, rings, area)``: the places within ``radius`` of the segments ``(keys..., x1, y1, x2, y2)``, tile by tile.

    A segment goes to each tile that its box meets and is cut to it there; pieces of neighbouring tiles don't
    overlap, so their areas add up, and however far a key reaches no task holds more than a tile of it.
    """
    cell = lambda a, b: F.sequence(F.floor((F.least(a, b) - radius) / tile), F.floor((F.greatest(a, b) + radius) / tile))
    placed = segments.select(*keys, "x1", "y1", "x2", "y2").distinct().withColumn("tx", F.explode(cell("x1", "x2"))).withColumn("ty", F.explode(cell("y1", "y2")))
    kinds = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)

    def united(g: pd.DataFrame) -> pd.DataFrame:
        left, low = g["tx"].iloc[0] * tile, g["ty"].iloc[0] * tile
        cuts = [clip_convex(capsule(*row, radius), left, low, left + tile, low + tile) for row in g[["x1", "y1", "x2", "y2"]].itertuples(index=False)]
        rings = union([[c] for c in cuts if len(c) > 2])
        out = g[[*keys, "tx", "ty"]].iloc[: int(bool(rings))]
        made = pd.Series([[[{"x": x, "y": y} for x, y in r] for r in rings]] * len(out), index=out.index, dtype=object)
        return out.assign(rings=made, area=shape_area(rings))

    return placed.groupBy(*keys, "tx", "ty").applyInPandas(united, f"{kinds}, tx long, ty long, rings array<array<struct<x:double,y:double>>>, area double")


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise, by Andrew's monotone chain."""
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) < 3:
        return pts

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def capsule(x1: float, y1: float, x2: float, y2: float, radius: float, corners: int = 8) -> np.ndarray:
    """A ring around all points within ``radius`` of a segment; half circles of ``corners`` steps."""
    turn = np.arctan2(y2 - y1, x2 - x1)
    steps = np.linspace(-np.pi / 2, np.pi / 2, corners + 1)
    ends = [np.c_[x + radius * np.cos(turn + a + steps), y + radius * np.sin(turn + a + steps)] for x, y, a in ((x2, y2, 0), (x1, y1, np.pi))]
    return np.vstack(ends)
