"""Rings that cross or touch themselves, taken apart into simple ones that enclose the same even-odd area.

A helper on one drawing's ring; rings of all slides are dealt out by Spark. Exact: crossing points are fractions.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

Point = tuple
Ring = list


def area(ring: Ring) -> Fraction:
    """Twice the signed area is divided once; positive against the clock, with y upward."""
    return Fraction(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])), 1) / 2


def encloses(ring: Ring, x, y) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < Fraction((x2 - x1) * (y - y1)) / (y2 - y1) + x1:
            inside = not inside
    return inside


def _meeting(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of segments whose boxes meet and of which neither lies wholly on one side of the other's line."""
    found = []
    side = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
    low, high = np.minimum(p, q), np.maximum(p, q)
    for i in range(len(p) - 1):
        a, b, c, d = p[i], q[i], p[i + 1 :], q[i + 1 :]
        near = (low[i] <= high[i + 1 :]).all(axis=1) & (low[i + 1 :] <= high[i]).all(axis=1)
        near &= (side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0)
        found += [(i, i + 1 + int(j)) for j in np.flatnonzero(near)]
    return found


def _common(a: Point, b: Point, c: Point, d: Point) -> list[Point]:
    """Points at which segments a b and c d must be cut: their crossing, or the ends that lie on the other."""
    r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    cross = r[0] * s[1] - r[1] * s[0]
    if cross:
        t = Fraction((c[0] - a[0]) * s[1] - (c[1] - a[1]) * s[0], cross)
        return [(a[0] + t * r[0], a[1] + t * r[1])]
    on = lambda e, f, x: min(e[0], f[0]) <= x[0] <= max(e[0], f[0]) and min(e[1], f[1]) <= x[1] <= max(e[1], f[1])
    return [x for x in (a, b) if on(c, d, x)] + [x for x in (c, d) if on(a, b, x)]


def pieces(rings: list[Ring]) -> list[tuple[Point, Point]]:
    """The segments of the rings, cut where they meet; those that lie on each other an even number of times are gone."""
    segments = [(tuple(a), tuple(b)) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]) if tuple(a) != tuple(b)]
    if not segments:
        return []
    p, q = (np.array([s[k] for s in segments], np.int64) for k in (0, 1))
    cuts: list[set] = [set(s) for s in segments]
    for i, j in _meeting(p, q):
        for x in _common(*segments[i], *segments[j]):
            cuts[i].add(x)
            cuts[j].add(x)
    odd: set = set()
    for (a, b), own in zip(segments, cuts):
        ordered = sorted(own, key=lambda x: (x[0] - a[0]) * (b[0] - a[0]) + (x[1] - a[1]) * (b[1] - a[1]))
        for x, y in zip(ordered, ordered[1:]):
            odd ^= {(min(x, y), max(x, y))}
    return sorted(odd)


def _directed(edges: list[tuple[Point, Point]]) -> list[tuple[Point, Point]]:
    """Each edge with the inside on its left."""
    out = []
    for a, b in edges:  # a < b: to the right, or straight up
        k = 0 if a[1] != b[1] else 1  # look along x, or for level edges along y
        at = Fraction(a[1 - k] + b[1 - k]) / 2
        here = Fraction(a[k] + b[k]) / 2
        beyond = 0
        for c, d in edges:
            if (c, d) != (a, b) and (c[1 - k] > at) != (d[1 - k] > at):
                beyond += Fraction((d[k] - c[k]) * (at - c[1 - k])) / (d[1 - k] - c[1 - k]) + c[k] > here
        inside = beyond % 2 == 1  # on the side of greater coordinates
        up = b[1] > a[1]
        forward = inside if k == 1 else inside != up
        out.append((a, b) if forward else (b, a))
    return out


def _turned(back: Point, out: Point) -> tuple:
    """Orders directions by how far they lie, with the clock, from ``back``: a half turn's side first, then by the angle."""
    cross = back[0] * out[1] - back[1] * out[0]
    dot = back[0] * out[0] + back[1] * out[1]
    if cross == 0:
        return (1 if dot < 0 else 3, 0)
    size = Fraction(dot * abs(dot), 1) / ((out[0] ** 2 + out[1] ** 2) * (back[0] ** 2 + back[1] ** 2))  # cosine's square with its sign
    return (0, -size) if cross < 0 else (2, size)


def simple_parts(rings: list[Ring]) -> list[tuple[Ring, list[Ring]]]:
    """(outer, holes) of the parts of the rings' even-odd area; no ring crosses itself or another one."""
    follow: dict[Point, list[Point]] = {}
    for a, b in _directed(pieces(rings)):
        follow.setdefault(a, []).append(b)
    loops = []
    while follow:
        start = min(follow)
        ring, before, at = [start], start, follow[start].pop()
        if not follow[start]:
            del follow[start]
        while at != start:
            ring.append(at)
            back = (before[0] - at[0], before[1] - at[1])
            nxt = min(follow[at], key=lambda x: _turned(back, (x[0] - at[0], x[1] - at[1])))
            follow[at].remove(nxt)
            if not follow[at]:
                del follow[at]
            before, at = at, nxt
        loops.append(_without_straight(ring))
    outers = sorted((r for r in loops if area(r) > 0), key=area)
    parts = [(r, []) for r in outers]
    for hole in (r for r in loops if area(r) < 0):
        # its middle of an edge, moved a little inward of the hole's rim, lies in the part around it
        (x1, y1), (x2, y2) = hole[0], hole[1]
        x, y = Fraction(x1 + x2) / 2, Fraction(y1 + y2) / 2
        own = next((holes for outer, holes in parts if abs(area(hole)) < area(outer) and _around(outer, hole, x, y)), None)
        if own is not None:
            own.append(hole)
    return parts[::-1]


def _around(outer: Ring, hole: Ring, x, y) -> bool:
    """Whether a hole lies in an outer ring that it may touch: by a point of it that is not on the outer ring."""
    on = {tuple(p) for p in outer}
    for (x1, y1), (x2, y2) in zip(hole, hole[1:] + hole[:1]):
        for p in ((x1, y1), (Fraction(x1 + x2) / 2, Fraction(y1 + y2) / 2)):
            if p not in on:
                return encloses(outer, *p)
    return encloses(outer, x, y)


def _without_straight(ring: Ring) -> Ring:
    kept = [p for a, p, b in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1]) if (p[0] - a[0]) * (b[1] - p[1]) != (p[1] - a[1]) * (b[0] - p[0])]
    return kept or ring


def is_simple(ring: Ring) -> bool:
    """No segment meets another but its neighbours at their common corner."""
    points = [tuple(p) for k, p in enumerate(ring) if tuple(p) != tuple(ring[k - 1])]
    if len(points) < 3 or len(set(points)) < len(points):
        return False
    p = np.array(points, np.int64)
    q = np.roll(p, -1, axis=0)
    n = len(points)
    for i, j in _meeting(p, q):
        common = {x for x in _common(points[i], points[(i + 1) % n], points[j], points[(j + 1) % n])}
        corner = {points[j]} if j == i + 1 else {points[i]} if (j + 1) % n == i else set()
        if common - corner:
            return False
    return True
