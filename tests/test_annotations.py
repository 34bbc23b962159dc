"""Painting of annotations against a plain painter that fills one ring after the other."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.functions import rings
from glasspane.operators import annotations


def plain(regions, side, scale=1.0):
    """regions: lists of rings (outer, holes); painted in order."""
    out = np.zeros((side, side), bool)
    for rings in regions:
        for k, ring in enumerate(rings):
            ring = [(int(x), int(y)) for x, y in ring]
            edges = list(zip(ring, ring[1:] + ring[:1]))
            for r in range(side):
                for c in range(side):
                    x, y = c * scale, r * scale
                    if sum((b[1] > y) != (e[1] > y) and x < (e[0] - b[0]) * (y - b[1]) / (e[1] - b[1]) + b[0] for b, e in edges) % 2:
                        out[r, c] = k == 0
            for b, e in edges:
                (x1, y1), (x2, y2) = [(int(np.floor(p[0] / scale)), int(np.floor(p[1] / scale))) for p in (b, e)]
                n = max(abs(x2 - x1), abs(y2 - y1))
                for t in range(n + 1):
                    c, r = (x1 + (2 * (x2 - x1) * t + n) // (2 * n), y1 + (2 * (y2 - y1) * t + n) // (2 * n)) if n else (x1, y1)
                    if 0 <= r < side and 0 <= c < side:
                        out[r, c] = k == 0
    return out


def painted(spark, slides, side, scale=1.0):
    feature = lambda rings: {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": rings}, "properties": {}}
    texts = spark.createDataFrame([(json.dumps([feature(r) for r in regions]), str(k)) for k, regions in enumerate(slides)], "json string, uri string")
    regions = annotations.valid(annotations.geojson_regions(texts)).withColumn("slide_id", F.col("uri").cast("long"))
    df = spark.range(len(slides) * side * side).select(F.expr(f"id div {side * side}").alias("slide_id"), F.expr(f"cast(id div {side} % {side} as int)").alias("r"), (F.col("id") % side).cast("int").alias("c"))
    out = np.zeros((len(slides), side, side), bool)
    got = annotations.annotation_mask(df, regions, "m", scale).collect()
    assert len(got) == out.size
    for r in got:
        out[r["slide_id"], r["r"], r["c"]] = r["m"]
    return out


square = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w]]


def test_regions_unite_and_show_in_holes(spark):
    overlapping = [[square(2, 2, 9)], [square(7, 7, 9)]]
    nested = [[square(1, 1, 18), square(4, 4, 10)], [square(7, 7, 3)]]
    covered = [[square(7, 7, 3)], [square(1, 1, 18), square(4, 4, 10)]]
    out = painted(spark, [overlapping, nested, covered], 24)
    assert out[0].sum() == 100 + 100 - 25  # an outline is part of its region: ten pixels a side
    assert out[0][8, 8] and out[1][8, 8] and not out[1][5, 5] and not out[2][8, 8]  # painted later, the hole takes off what it covers
    for k, regions in enumerate((overlapping, nested, covered)):
        assert (out[k] == plain(regions, 24)).all()


@pytest.mark.parametrize("scale", [1.0, 2.5])
def test_like_plain_painter(spark, scale):
    rng = np.random.default_rng(4)
    ring = lambda: rng.integers(-4, 40, (int(rng.integers(3, 7)), 2)).tolist()
    slides = [[[ring() for _ in range(int(rng.integers(1, 3)))] for _ in range(int(rng.integers(1, 5)))] for _ in range(5)]
    out = painted(spark, slides, 32, scale)
    for k, regions in enumerate(slides):
        assert (out[k] == plain(regions, 32, scale)).all()


def test_outline_of_thin_regions(spark):
    """A region thinner than a pixel has an outline all the same."""
    out = painted(spark, [[[[[1, 1], [12, 5], [1, 1]]]]], 16)[0]
    assert [out[:, c].sum() for c in range(14)] == [0] + [1] * 12 + [0]


def even_odd(rings, x, y):
    return sum(rings_encloses(r, x, y) for r in rings) % 2 == 1


def rings_encloses(ring, x, y):
    return sum((b[1] > y) != (e[1] > y) and x < (e[0] - b[0]) * (y - b[1]) / (e[1] - b[1]) + b[0] for b, e in zip(ring, ring[1:] + ring[:1])) % 2


@pytest.mark.parametrize("seed", range(12))
def test_parts_have_the_even_odd_area(seed):
    """Random rings, many of which cross and touch themselves: parts are simple, apart from each other, and cover the same places."""
    rng = np.random.default_rng(seed)
    side = int(rng.integers(3, 12))
    given = [[tuple(map(int, p)) for p in rng.integers(0, side, (int(rng.integers(3, 9)), 2))] for _ in range(int(rng.integers(1, 3)))]
    parts = rings.simple_parts(given)
    for x in np.arange(-0.47137, side + 0.5, 0.31319):
        for y in np.arange(-0.43291, side + 0.5, 0.29173):
            inside = [rings_encloses(o, x, y) and not any(rings_encloses(h, x, y) for h in hs) for o, hs in parts]
            assert sum(inside) == even_odd(given, x, y)
    for outer, holes in parts:
        assert rings.area(outer) > 0 and all(rings.area(h) < 0 for h in holes)
        assert all(len(set(r)) == len(r) for r in [outer, *holes])


def test_known_rings():
    bow = [(0, 0), (4, 4), (4, 0), (0, 4)]
    assert not rings.is_simple(bow) and [rings.area(o) for o, _ in rings.simple_parts([bow])] == [4, 4]
    box = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert rings.is_simple(box) and rings.is_simple(box[::-1]) and rings.simple_parts([box + box]) == []  # twice around encloses nothing by even-odd
    touching = [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)]
    assert not rings.is_simple(touching) and len(rings.simple_parts([touching])) == 2
    spike = [(0, 0), (4, 0), (4, 4), (6, 4), (4, 4), (0, 4)]
    assert not rings.is_simple(spike) and [rings.area(o) for o, _ in rings.simple_parts([spike])] == [16]
    ((outer, holes),) = rings.simple_parts([box, [(1, 1), (2, 1), (2, 2), (1, 2)]])
    assert rings.area(outer) == 16 and [rings.area(h) for h in holes] == [-1]


def test_regions_are_repaired(spark):
    bow, box = [[0, 0], [8, 8], [8, 0], [0, 8]], square(20, 0, 6)
    feature = lambda r: {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": r}, "properties": {}}
    line = [[30, 30], [40, 40], [30, 30]]
    texts = spark.createDataFrame([(json.dumps([feature([bow]), feature([box, square(22, 2, 2)]), feature([line])]), "0")], "json string, uri string")
    got = annotations.repaired(annotations.valid(annotations.geojson_regions(texts))).orderBy("position", "part").collect()
    assert [(r["position"], r["part"], r["repaired"], len(r["outer"]), len(r["holes"])) for r in got] == [(0, 0, True, 3, 0), (0, 1, True, 3, 0), (1, 0, False, 4, 1), (2, 0, True, 3, 0)]
    assert (painted(spark, [[[bow]]], 10)[0] == plain([[bow]], 10)).all()
