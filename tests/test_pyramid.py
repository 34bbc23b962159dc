"""The pyramid source: which tiles it reads, its pictures, and thumbnails."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.functions import kernels
from glasspane.sources import pyramid


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('pyramid')}/slides"
    rows = spark.range(2 * 50 * 70).select(F.expr("id div 3500").alias("slide_id"), F.expr("cast(id div 70 % 50 as int)").alias("r"), F.expr("cast(id % 70 as int)").alias("c"))
    pixels = rows.select("slide_id", "r", "c", (F.col("r") * 5).alias("red"), (F.col("c") * 3).alias("green"), F.expr("cast((r * c + slide_id) % 256 as int)").alias("blue"))
    pyramid.write(pixels, at, tile=16)
    return at


def plain(slide):
    r, c = np.mgrid[0:50, 0:70]
    return np.stack([r * 5, c * 3, (r * c + slide) % 256], axis=2)


def half(a):
    h, w = a.shape[:2]
    return np.stack([[np.rint(a[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].reshape(-1, 3).mean(axis=0)) for j in range(-(-w // 2))] for i in range(-(-h // 2))]).astype(int)


def raster(rows, shape):
    out = np.full((*shape, 3), -1)
    for r in rows:
        out[r["r"], r["c"]] = r["red"], r["green"], r["blue"]
    return out


def test_levels(spark, folder):
    want = plain(1)
    for level, (h, w) in enumerate(((50, 70), (25, 35), (13, 18), (7, 9))):
        got = pyramid.read(spark, folder).where((F.col("slide_id") == "1") & (F.col("level") == level)).collect()
        assert len(got) == h * w and (raster(got, (h, w)) == want).all()
        want = half(want)
    assert pyramid.read(spark, folder).where("level = 4").collect() == []


def test_only_the_tiles_of_a_box_are_read(spark, folder):
    """50 x 70 at 16: 4 x 5 tiles; one task a tile, so tasks count tiles."""
    parts = lambda df: df.rdd.getNumPartitions()
    every = pyramid.read(spark, folder, tiles_per_task=1)
    assert parts(every) == 2 * (20 + 6 + 2 + 1)
    assert parts(every.where("level = 1")) == 12 and parts(every.where("level = 0 and slide_id = '0'")) == 20
    box = pyramid.region(spark, folder, 0, left=20, top=17, width=14, height=14, tiles_per_task=1)
    assert parts(box) == 2 * 2
    got = box.where("slide_id = '0'").collect()
    assert len(got) == 14 * 14 and {(r["tile_r"], r["tile_c"]) for r in got} == {(1, 1), (1, 2)}
    assert all((r["red"], r["green"]) == (r["r"] * 5, r["c"] * 3) for r in got)
    assert parts(pyramid.read(spark, folder, tiles_per_task=7).where("level = 0")) == 2 * 3
    assert pyramid.read(spark, folder).where("slide_id = 'none'").collect() == []


def test_other_tiles_may_be_missing(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder.removeprefix("file://"), tmp_path / "s")
    (tmp_path / "s" / "0_files" / "7" / "0_0.png").unlink()
    assert pyramid.region(spark, str(tmp_path / "s"), 0, 40, 20, 5, 5).count() == 50
    (tmp_path / "s" / "1_files" / "5" / "0_0.png").write_bytes(b"no picture")
    assert pyramid.thumbnail(spark, str(tmp_path / "s"), 2, 4).count() == 2 * 25 * 35
    with pytest.raises(Exception, match="0_0.png: no PNG picture"):
        pyramid.thumbnail(spark, str(tmp_path / "s"), 4, 4).collect()


def test_thumbnail_of_the_best_level(spark, folder):
    assert [pyramid.best_level(spark, f, 4) for f in (1, 2, 3, 4, 7, 8, 8.05, 30)] == [0, 1, 1, 2, 2, 3, 3, 3]
    got = pyramid.thumbnail(spark, folder, 4, levels=4).where("slide_id = '0'").collect()
    assert (raster(got, (13, 18)) == half(half(plain(0)))).all()


def filtered(a, kinds):
    """A picture whose rows take the given filters in turn."""
    h, w, n = a.shape
    lines, zero = b"", np.zeros((w, n), int)
    for r in range(h):
        own, up = a[r].astype(int), a[r - 1].astype(int) if r else zero
        left, corner = np.vstack([zero[:1], own[:-1]]), np.vstack([zero[:1], up[:-1]])
        p = left + up - corner
        d = [abs(p - x) for x in (left, up, corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        k = kinds[r % len(kinds)]
        lines += bytes([k]) + ((own - (0, left, up, (left + up) // 2, paeth)[k]) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_pictures_are_decoded(n):
    a = np.random.default_rng(n).integers(0, 256, (11, 7, n)).astype(np.uint8)
    for kinds in ([0], [1], [2], [3], [4], [4, 1, 3, 0, 2]):
        assert (kernels.unpng(filtered(a, kinds)) == a).all()
    with pytest.raises(ValueError):
        kernels.unpng(filtered(a, [0])[:60])
