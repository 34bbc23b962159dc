"""Blocks against whole-slide kernels: the same at every seam, and in a task that cannot hold the slide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.functions import kernels
from glasspane.operators import blocks, raster
from glasspane.operators.components import connected

SHAPES = [(37, 45), (20, 16), (5, 50)]


@pytest.fixture(scope="module")
def slides(spark):
    rng = np.random.default_rng(8)
    arrays = [rng.integers(0, 256, s) for s in SHAPES]
    rows = [(k, r, c, int(a[r, c]), bool(a[r, c] < 120), True) for k, a in enumerate(arrays) for r in range(a.shape[0]) for c in range(a.shape[1])]
    rows = [x for x in rows if not (x[0] == 0 and x[1] > 34 and x[2] > 30)]  # a ragged corner
    return spark.createDataFrame(rows, "slide_id long, r int, c int, v int, m boolean, use boolean").repartition(3).cache()


def same(a, b, name):
    key = ["slide_id", "r", "c"]
    x, y = ({tuple(r[k] for k in key): r[name] for r in df.select(*key, name).collect()} for df in (a, b))
    assert x.keys() == y.keys() and all(x[k] == y[k] or x[k] is not None and abs(x[k] - y[k]) < 1e-9 for k in x)


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("block", [4, 7, 64])
def test_components(slides, connectivity, block):
    same(blocks.label_components(slides, "m", connectivity, "l", block), raster.label_components(slides, "m", connectivity, "l"), "l")


def test_by_area(slides):
    for got, want in ((blocks.remove_small(slides, "m", 6, "x", block=8), raster.remove_small(slides, "m", 6, "x")), (blocks.remove_large(slides, "m", 9, "x", block=8), raster.remove_large(slides, "m", 9, "x")), (blocks.fill_holes(slides, "m", 5, "x", block=8), raster.fill_holes(slides, "m", 5, "x")), (blocks.fat_like(slides, "m", 12, 3, 20, "x", block=8), raster.fat_like(slides, "m", 12, 3, 20, "x"))):
        same(got.where("slide_id > 0"), want.where("slide_id > 0"), "x")  # whole-slide filling counts missing pixels as tissue; so does a block's edge
    got, want = (f(slides.where("slide_id > 0").withColumn("m", F.col("m") & (F.col("slide_id") == 1)), "m", 8, "p_", **more).collect() for f, more in ((blocks.region_statistics, {"block": 6}), (raster.region_statistics, {})))
    assert sorted(got) == sorted(want)


def test_footprints(slides):
    same(blocks.blurred(slides, "v", 1.3, "x", 9), raster.blurred(slides, "v", 1.3, "x"), "x")
    same(blocks.lowest(slides, "v", 3, "x", 5), raster.per_slide(slides, lambda a: {"x": kernels.lowest(a["v"], kernels.disk(3))}, ["v"], {"x": "int"}), "x")
    same(blocks.median(slides, "v", 2, "x", 8), raster.per_slide(slides, lambda a: {"x": kernels.median(a["v"], 2)}, ["v"], {"x": "double"}), "x")
    opened = slides.withColumn("m", F.col("v") < 235)
    same(blocks.open_disk(opened, "m", 2, "x", 6), raster.open_disk(opened, "m", 2, "x"), "x")
    same(blocks.dilate(slides, "m", 4, "x", 6), raster.per_slide(slides, lambda a: {"x": kernels.dilated(a["m"], kernels.square(4)) & a["present"]}, ["m"], {"x": "boolean"}), "x")


def test_no_task_holds_a_slide(spark):
    """One winding component over a slide of 300 x 300, in blocks of 32: a kernel that gets more than a block and its margin raises."""
    df = spark.range(300 * 300).select(F.lit(1).cast("long").alias("slide_id"), F.expr("cast(id div 300 as int)").alias("r"), F.expr("cast(id % 300 as int)").alias("c"))
    snake = df.withColumn("m", (F.col("r") % 2 == 0) | F.when(F.col("r") % 4 == 1, F.col("c") == 299).otherwise(F.col("c") == 0))
    stats = blocks.region_statistics(snake, "m", 4, block=32).collect()
    assert [(r["num_regions"], r["max_area"]) for r in stats] == [(1, 150 * 300 + 150)]

    def held(x):
        if x["present"].size > (32 + 2 * 5) ** 2:
            raise MemoryError
        return {"n": x["present"].astype(int)}

    assert blocks.with_margins(df, held, [], {"n": "int"}, 5, 32).agg(F.sum("n")).first()[0] == 90_000


def test_connected(spark):
    rng = np.random.default_rng(2)
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(70)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: root(k) for k in list(parent)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
