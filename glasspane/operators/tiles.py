"""Tile extraction: grids over the tissue's bounding box, tissue share by summed areas, windows of the slide."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels


def tissue_boxes(df: DataFrame, mask: str, component: str | None = None) -> DataFrame:
    """slide_id, region, top, left, bottom, right (half open): one box of all tissue, or one per component label."""
    region = F.col(component) if component else F.lit(0).cast("long")
    return df.where(F.col(mask)).groupBy("slide_id", region.alias("region")).agg(F.min("r").alias("top"), F.min("c").alias("left"), (F.max("r") + 1).alias("bottom"), (F.max("c") + 1).alias("right"))


def grid(boxes: DataFrame, tile: int, stride: int, factor: float) -> DataFrame:
    """slide_id, region, left, top, right, bottom on the mask: columns outermost.

    Starts go from the box's edge in whole steps of the stride cut to pixels, as many as the uncut stride has room for.
    """
    t, s = tile / factor, stride / factor

    def starts(low: str, high: str):
        stop = (F.col(high) - F.lit(t)).cast("int") + 1
        n = F.greatest(F.ceil((stop - F.col(low)) / F.lit(s)), F.lit(0)).cast("int")
        step = (F.col(low) + F.lit(s)).cast("int") - F.col(low)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col(low) + k * step))

    tiles = boxes.withColumn("l", F.explode(starts("left", "right"))).withColumn("t", F.explode(starts("top", "bottom")))
    return tiles.select("slide_id", "region", F.col("l").cast("double").alias("left"), F.col("t").cast("double").alias("top"), (F.col("l") + F.lit(t)).alias("right"), (F.col("t") + F.lit(t)).alias("bottom"))


def summed_area(df: DataFrame, mask: str) -> DataFrame:
    """slide_id, r, c, area: mask pixels above and left of each pixel, itself included."""
    row = df.withColumn("__m", F.col(mask).cast("int")).selectExpr("slide_id", "r", "c", "sum(__m) over (partition by slide_id, r order by c) as __s")
    return row.selectExpr("slide_id", "r", "c", "sum(__s) over (partition by slide_id, c order by r) as area")


def with_tissue(tiles: DataFrame, df: DataFrame, mask: str, least: float) -> DataFrame:
    """Tiles at least so much of which is tissue; corners are rounded half to even, and beyond the raster counts as none.

    Each tile looks up four corners of the summed-area table, so no tile meets its pixels.
    """
    area = summed_area(df, mask)
    size = df.groupBy("slide_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    corner = lambda x: F.bround(F.col(x)).cast("int")
    placed = tiles.join(size, "slide_id").withColumns({"r0": corner("top"), "r1": corner("bottom"), "c0": corner("left"), "c1": corner("right")})
    clipped = placed.withColumns({"a0": F.greatest("r0", F.lit(0)), "a1": F.least("r1", "height"), "b0": F.greatest("c0", F.lit(0)), "b1": F.least("c1", "width")})
    signs = F.explode(F.array(*[F.struct((F.col(a) - 1).alias("r"), (F.col(b) - 1).alias("c"), F.lit(s).alias("sign")) for a, b, s in (("a1", "b1", 1), ("a0", "b1", -1), ("a1", "b0", -1), ("a0", "b0", 1))]))
    names = [*tiles.columns, "r0", "r1", "c0", "c1"]
    looked = clipped.select(*names, signs.alias("x")).select(*names, "x.*").join(area, ["slide_id", "r", "c"], "left")
    share = F.sum(F.col("sign") * F.coalesce("area", F.lit(0))) / ((F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")))
    return looked.groupBy(*names).agg(share.alias("tissue")).where(F.col("tissue") >= least).select(*tiles.columns, "tissue")


def zoomed(tiles: DataFrame, factor: float) -> DataFrame:
    """Windows in the slide's own pixels, cut to whole ones."""
    return tiles.withColumns({n: (F.col(n) * F.lit(factor)).cast("int") for n in ("left", "top", "right", "bottom")})


def as_json(tiles: DataFrame) -> DataFrame:
    """slide_id, tiles: the windows of each region as nested lists [[[left, top, right, bottom], ...], ...]."""
    window = F.array("left", "top", "right", "bottom")
    by_region = tiles.groupBy("slide_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("left", "top", window.alias("w")))), lambda x: x["w"]).alias("w"))
    return by_region.groupBy("slide_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("region", "w"))), lambda x: x["w"])).alias("tiles"))


def extract_tiles(df: DataFrame, mask: str, slide_width: int, mask_width: int, tile: int = 256, stride: int = 256, least: float = 0.5, component: str | None = None, screen=None) -> DataFrame:
    """Accepted windows in slide pixels. ``screen``: a further condition, as a column of the windows."""
    factor = slide_width / mask_width
    kept = with_tissue(grid(tissue_boxes(df, mask, component), tile, stride, factor), df, mask, least)
    found = zoomed(kept, factor)
    return found if screen is None else found.where(screen)


# --- tiles' pixels --------------------------------------------------------------------------------------------------

#: Predicates on a tile's (height, width, 3) bytes by name; each takes a limit.
SCREENS: dict[str, Callable[[float | None], Callable[[np.ndarray], bool]]] = {
    "all": lambda limit: lambda a: True,
    "saturation": lambda limit: lambda a: float((a.max(axis=2).astype(int) - a.min(axis=2)).mean()) >= (20 if limit is None else limit),
    "not_white": lambda limit: lambda a: float(a.mean()) <= (230 if limit is None else limit),
}


def packed(df: DataFrame, block: int = 256) -> DataFrame:
    """slide_id, i, j, data: a slide's pixels as squares of bytes, red, green and blue by turns; what is missing is black."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((block, block, 3), np.uint8)
        a[pdf["r"] % block, pdf["c"] % block] = pdf[["red", "green", "blue"]].to_numpy()
        first = pdf.iloc[0]
        return pd.DataFrame({"slide_id": [first["slide_id"]], "i": [int(first["i"])], "j": [int(first["j"])], "data": [a.tobytes()]})

    placed = df.select("slide_id", "r", "c", "red", "green", "blue", F.expr(f"cast(r div {block} as int)").alias("i"), F.expr(f"cast(c div {block} as int)").alias("j"))
    fields = [df.schema["slide_id"], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("data", T.BinaryType())]
    return placed.groupBy("slide_id", "i", "j").applyInPandas(run, T.StructType(fields))


def with_pixels(tiles: DataFrame, pixels: DataFrame, function: Callable[[np.ndarray], object], name: str, kind: str, block: int = 256) -> DataFrame:
    """Tiles (windows in whole slide pixels) with what the function makes of their pixels; beyond the slide is black.

    A tile meets the squares of pixels that it overlaps, four or so, and is put together in a task of its own: no row
    is made for a pixel of a tile.
    """
    keys, columns = ["slide_id", "region", "left", "top", "right", "bottom"], tiles.columns
    # negative starts, and windows that end before they start, meet no square and stay black
    span = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(F.col(low), F.lit(0)) / block).cast("int"), F.greatest(F.floor((F.col(high) - 1) / block), F.floor(F.greatest(F.col(low), F.lit(0)) / block)).cast("int")))
    asked = tiles.withColumn("i", span("top", "bottom")).withColumn("j", span("left", "right"))
    met = asked.join(packed(pixels, block), ["slide_id", "i", "j"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        left, top, right, bottom = (int(first[k]) for k in keys[2:])
        a = np.zeros((max(0, bottom - top), max(0, right - left), 3), np.uint8)
        for i, j, data in zip(pdf["i"], pdf["j"], pdf["data"]):
            if data is None:
                continue
            own = np.frombuffer(data, np.uint8).reshape(block, block, 3)
            r0, r1 = max(top, i * block), min(bottom, (i + 1) * block)
            c0, c1 = max(left, j * block), min(right, (j + 1) * block)
            if r0 < r1 and c0 < c1:
                a[r0 - top : r1 - top, c0 - left : c1 - left] = own[r0 - i * block : r1 - i * block, c0 - j * block : c1 - j * block]
        return first[columns].to_frame().T.assign(**{name: [function(a)]})

    schema = T.StructType([*(tiles.schema[c] for c in tiles.columns), T.StructField(name, T._parse_datatype_string(kind))])
    return met.groupBy(*keys).applyInPandas(run, schema)


def screened(tiles: DataFrame, pixels: DataFrame, screen: Callable[[np.ndarray], bool], block: int = 256) -> DataFrame:
    """The tiles whose pixels a predicate accepts."""
    return with_pixels(tiles, pixels, lambda a: bool(screen(a)), "__kept", "boolean", block).where("__kept").drop("__kept")


def pictures(tiles: DataFrame, pixels: DataFrame, block: int = 256) -> DataFrame:
    """The tiles with png, their pictures."""
    return with_pixels(tiles, pixels, kernels.png, "png", "binary", block)
