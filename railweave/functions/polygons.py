"""Unions of polygons by vertical slabs, in plain NumPy: kernels for bounded groups.

A shape is a list of rings under the even-odd rule, each a list of (x, y), closed or not.  Between two
neighbouring x of corners and crossings no sides cross, so each shape is a few trapezoids there, and their
union is that of intervals.  The borders of the united intervals are put together to rings again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np

#: Heights at one x that count as one place.
SAME = 1e-6


def ring_area(ring: Sequence) -> float:
    """The area of a ring, positive if its corners run counter-clockwise."""
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def shape_area(rings: Sequence[Sequence]) -> float:
    """The area of a shape whose rings don't cross: outer rings counter-clockwise, holes clockwise, as ``union`` gives them."""
    return sum(map(ring_area, rings))


def clip_convex(ring: Sequence, x1: float, y1: float, x2: float, y2: float) -> list[tuple[float, float]]:
    """A convex ring cut to a box, side by side."""
    out = [(float(x), float(y)) for x, y in ring]
    for axis, limit, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
        kept: list[tuple[float, float]] = []
        for p, q in zip(out, [*out[1:], *out[:1]]):
            a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if a >= 0:
                kept.append(p)
            if (a > 0 > b) or (a < 0 < b):
                t = a / (a - b)
                cut = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
                cut[axis] = limit
                kept.append((cut[0], cut[1]))
        out = kept
    return out


def _sides(rings: Sequence[Sequence]) -> np.ndarray:
    out = []
    for ring in rings:
        p = np.asarray(ring, float)
        if len(p) > 1 and np.array_equal(p[0], p[-1]):
            p = p[:-1]
        if len(p) > 2:
            out.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    return np.vstack(out) if out else np.zeros((0, 4))


def _crossing_x(s: np.ndarray) -> np.ndarray:
    """The x of all places where two sides cross."""
    found = []
    dx, dy = s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
    lo, hi = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
    for k in range(len(s)):
        near = np.flatnonzero((lo[k + 1 :, 0] <= hi[k, 0]) & (hi[k + 1 :, 0] >= lo[k, 0]) & (lo[k + 1 :, 1] <= hi[k, 1]) & (hi[k + 1 :, 1] >= lo[k, 1])) + k + 1
        if not len(near):
            continue
        den = dx[k] * dy[near] - dy[k] * dx[near]
        with np.errstate(all="ignore"):
            t = ((s[near, 0] - s[k, 0]) * dy[near] - (s[near, 1] - s[k, 1]) * dx[near]) / den
            u = ((s[near, 0] - s[k, 0]) * dy[k] - (s[near, 1] - s[k, 1]) * dx[k]) / den
        hit = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        found.append(s[k, 0] + t[hit] * dx[k])
    return np.concatenate(found) if found else np.zeros(0)


def _snapped(values: list[float]) -> dict[float, float]:
    """Each value with the least of those that lie within ``SAME`` of each other, one after the other."""
    out: dict[float, float] = {}
    first = before = None
    for v in sorted(set(values)):
        if before is None or v - before > SAME:
            first = v
        out[v] = first
        before = v
    return out


def union(shapes: Sequence[Sequence[Sequence]]) -> list[list[tuple[float, float]]]:
    """The rings of the union: outer ones counter-clockwise, holes clockwise; none for nothing."""
    owned = [(k, side) for k, shape in enumerate(shapes) for side in _sides(shape)]
    if not owned:
        return []
    owner, s = np.array([k for k, _ in owned]), np.array([side for _, side in owned])
    xs = np.unique(np.r_[s[:, 0], s[:, 2], _crossing_x(s)])
    xs = xs[np.r_[True, np.diff(xs) > SAME / 100]]
    lo, hi = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2])
    slabs: list[list[tuple[float, float, float, float]]] = []
    for a, b in zip(xs[:-1], xs[1:]):
        middle = (a + b) / 2
        own = np.flatnonzero((lo < middle) & (hi > middle))
        slope = (s[own, 3] - s[own, 1]) / (s[own, 2] - s[own, 0])
        height = lambda x: s[own, 1] + (x - s[own, 0]) * slope  # noqa: B023, E731
        left, right, mid = height(a), height(b), height(middle)
        order = np.lexsort((mid, owner[own]))
        spans = sorted((mid[i], mid[j], left[i], left[j], right[i], right[j]) for i, j in zip(order[::2], order[1::2]))
        merged: list[list[float]] = []
        for m1, m2, l1, l2, r1, r2 in spans:
            if merged and m1 <= merged[-1][1] + SAME:
                if m2 > merged[-1][1]:
                    merged[-1][1], merged[-1][3], merged[-1][5] = m2, l2, r2
            else:
                merged.append([m1, m2, l1, l2, r1, r2])
        slabs.append([(m[2], m[3], m[4], m[5]) for m in merged])
    edges: dict[tuple[float, float], list[tuple[float, float]]] = defaultdict(list)
    snaps = []
    for k, x in enumerate(xs):
        heights = [v for t in (slabs[k - 1] if k else []) for v in t[2:]] + [v for t in (slabs[k] if k < len(slabs) else []) for v in t[:2]]
        snaps.append(_snapped(heights))

    def add(p, q):
        if p != q:
            edges[p].append(q)

    for k, trapezoids in enumerate(slabs):
        for l1, l2, r1, r2 in trapezoids:
            add((xs[k], snaps[k][l1]), (xs[k + 1], snaps[k + 1][r1]))
            add((xs[k + 1], snaps[k + 1][r2]), (xs[k], snaps[k][l2]))
    for k, x in enumerate(xs):
        before = [(snaps[k][t[2]], snaps[k][t[3]]) for t in (slabs[k - 1] if k else [])]
        after = [(snaps[k][t[0]], snaps[k][t[1]]) for t in (slabs[k] if k < len(slabs) else [])]
        breaks = sorted({v for i in before + after for v in i})
        for low, high in zip(breaks[:-1], breaks[1:]):
            inside = lambda spans: any(a <= low and b >= high for a, b in spans)  # noqa: B023, E731
            one, two = inside(before), inside(after)
            if one and not two:
                add((x, low), (x, high))
            elif two and not one:
                add((x, high), (x, low))
    return _rings(edges)


def _rings(edges: dict) -> list[list[tuple[float, float]]]:
    """Directed border pieces put together to rings, corners on straight lines left out."""
    out = []
    while edges:
        start = here = next(iter(edges))
        ring = [start]
        while True:
            ends = edges[here]
            here = ends.pop()
            if not ends:
                del edges[ring[-1]]
            if here == start:
                break
            if here not in edges:  # a border that isn't closed: nothing there is wider than SAME
                break
            ring.append(here)
        corners = []
        for p, q, r in zip([ring[-1], *ring[:-1]], ring, [*ring[1:], ring[0]]):
            straight = abs((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])) <= 1e-9 * (1 + abs(r[0] - p[0]) + abs(r[1] - p[1]))
            if not straight:
                corners.append((float(q[0]), float(q[1])))
        if len(corners) > 2:
            out.append(corners)
    return out
