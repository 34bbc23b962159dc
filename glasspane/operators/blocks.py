"""Slides larger than a task: rasters cut into square blocks, with margins for footprints and seams for components.

Two forms cover the kernels that ``raster`` runs on whole slides:

* ``with_margins``: a block carries a margin of its neighbours' pixels, as wide as the footprint reaches, and keeps
  only what lies in the block itself. At the slide's own edge the margin ends, so the kernel's rule for what
  lies beyond the raster applies there and nowhere else.
* ``label_components``: each block labels its own components; labels that touch across a seam are edges of a graph,
  whose components (``components.connected``) join them. Only pixels at seams and one row a block's component
  leave the blocks. A component is named by its first pixel, as in ``raster``.

No task holds more than a block and its margin, however large the slide. Results are those of the whole-slide kernels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..session import stored
from .components import connected
from .raster import CODE

BLOCK = 512


def extents(df: DataFrame) -> DataFrame:
    """slide_id and the edges of its raster: a row a slide."""
    return df.groupBy("slide_id").agg(F.min("r").alias("__top"), F.max("r").alias("__bottom"), F.min("c").alias("__left"), F.max("c").alias("__right"))


def _reached(place: str, low: str, high: str, block: int, margin: int) -> Column:
    """The numbers of the blocks along one axis whose extent, widened by the margin, holds the place."""
    own = F.col(place) - F.col(low)
    first = F.greatest(F.lit(0), F.floor((own - margin) / block))
    last = F.least(F.floor((F.col(high) - F.col(low)) / block), F.floor((own + margin) / block))
    return F.explode(F.sequence(first.cast("int"), last.cast("int")))


def with_margins(df: DataFrame, function: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], inputs: list[str], outputs: dict[str, str], margin: int, block: int = BLOCK) -> DataFrame:
    """df and the outputs that the function makes of a slide's rasters, block by block (missing pixels: 0 or false).

    The function must not look further than ``margin`` pixels from a place. A pixel goes to (1 + 2 margin / block)^2 blocks.
    """
    edges = extents(df)
    near = df.select("slide_id", "r", "c", *inputs).join(edges, "slide_id")
    near = near.withColumn("__i", _reached("r", "__top", "__bottom", block, margin)).withColumn("__j", _reached("c", "__left", "__right", block, margin))
    schema = T.StructType([*(df.schema[k] for k in ("slide_id", "r", "c")), *(T.StructField(k, T._parse_datatype_string(t)) for k, t in outputs.items())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf.iloc[0]
        top, left = int(e["__top"]) + int(e["__i"]) * block, int(e["__left"]) + int(e["__j"]) * block
        r0, c0 = max(int(e["__top"]), top - margin), max(int(e["__left"]), left - margin)
        shape = (min(int(e["__bottom"]), top + block - 1 + margin) - r0 + 1, min(int(e["__right"]), left + block - 1 + margin) - c0 + 1)
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        rasters = {"present": np.zeros(shape, bool)}
        rasters["present"][r - r0, c - c0] = True
        for name in inputs:
            values = pdf[name].to_numpy()
            rasters[name] = np.zeros(shape, values.dtype if values.dtype != object else bool)
            rasters[name][r - r0, c - c0] = values
        made = function(rasters)
        own = (r >= top) & (r < top + block) & (c >= left) & (c < left + block)
        return pd.DataFrame({"slide_id": pdf["slide_id"][own], "r": r[own], "c": c[own], **{k: made[k][r[own] - r0, c[own] - c0] for k in outputs}})

    made = near.groupBy("slide_id", "__i", "__j").applyInPandas(run, schema)
    return df.drop(*outputs).join(made, ["slide_id", "r", "c"])


# --- footprints --------------------------------------------------------------------------------


def blurred(df: DataFrame, value: str, sigma: float, name: str = "blurred", block: int = BLOCK) -> DataFrame:
    return with_margins(df, lambda x: {name: kernels.gaussian(x[value].astype(float), sigma)}, [value], {name: "double"}, len(kernels.gaussian_weights(sigma)) // 2, block)


def lowest(df: DataFrame, value: str, radius: int, name: str = "lowest", block: int = BLOCK) -> DataFrame:
    return with_margins(df, lambda x: {name: kernels.lowest_disk(x[value], radius)}, [value], {name: "int"}, radius, block)


def median(df: DataFrame, value: str, radius: int, name: str = "median", block: int = BLOCK) -> DataFrame:
    return with_margins(df, lambda x: {name: kernels.median(x[value], radius)}, [value], {name: "double"}, radius, block)


def open_disk(df: DataFrame, mask: str, radius: int = 25, name: str | None = None, block: int = BLOCK) -> DataFrame:
    """Opening looks twice as far as its disk."""
    return with_margins(df, lambda x: {name or mask: kernels.opened(x[mask] | ~x["present"], radius) & x[mask]}, [mask], {name or mask: "boolean"}, 2 * radius, block)


def dilate(df: DataFrame, mask: str, side: int, name: str, block: int = BLOCK) -> DataFrame:
    return with_margins(df, lambda x: {name: kernels.dilated(x[mask], kernels.square(side)) & x["present"]}, [mask], {name: "boolean"}, side // 2, block)


# --- components --------------------------------------------------------------------------------


def _labelled(df: DataFrame, mask: str, connectivity: int, block: int, carried: list[str]) -> DataFrame:
    """slide_id, r, c, carried and __part: the first pixel of the block's component, null outside the mask."""
    schema = T.StructType([*(df.schema[k] for k in ("slide_id", "r", "c", *carried)), T.StructField("__part", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, m = pdf["r"].to_numpy().astype(np.int64), pdf["c"].to_numpy().astype(np.int64), pdf[mask].to_numpy().astype(bool)
        raster = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
        raster[r - r.min(), c - c.min()] = m
        labels = kernels.label(raster, connectivity)[r - r.min(), c - c.min()]
        first = np.full(labels.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, labels, r * CODE + c)
        part = pd.Series(first[labels], index=pdf.index).astype("Int64").where(pd.Series(m, index=pdf.index))
        return pdf[["slide_id", "r", "c", *carried]].assign(__part=part)

    dealt = df.select("slide_id", "r", "c", *dict.fromkeys([mask, *carried])).withColumns({"__i": F.expr(f"r div {block}"), "__j": F.expr(f"c div {block}")})
    return dealt.groupBy("slide_id", "__i", "__j").applyInPandas(run, schema)


def _seams(parts: DataFrame, connectivity: int, block: int) -> DataFrame:
    """slide_id, a, b: components of blocks that touch across a seam."""
    at = parts.where("__part is not null")
    # from a block's first row or column to the neighbours before it
    above = [(-1, d) for d in ((-1, 0, 1) if connectivity == 8 else (0,))]
    before = [(d, -1) for d in ((-1, 0, 1) if connectivity == 8 else (0,))]
    steps = lambda ds: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ds])
    none = F.array().cast("array<struct<i:int,j:int>>")
    look = F.concat(F.when(F.col("r") % block == 0, steps(above)).otherwise(none), F.when(F.col("c") % block == 0, steps(before)).otherwise(none))
    if connectivity == 8:  # a diagonal neighbour to the upper right lies beyond the seam behind a block's last column
        look = F.concat(look, F.when(F.col("c") % block == block - 1, steps([(-1, 1)])).otherwise(none))
    rim = at.where(F.expr(f"r % {block} in (0, {block - 1}) or c % {block} in (0, {block - 1})"))
    asked = rim.select("slide_id", F.col("__part").alias("a"), "r", "c", F.explode(look).alias("d")).select("slide_id", "a", (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c"))
    return asked.join(rim.select("slide_id", "r", "c", F.col("__part").alias("b")), ["slide_id", "r", "c"]).where("a <> b").select("slide_id", "a", "b").distinct()


def _roots(parts: DataFrame, connectivity: int, block: int) -> DataFrame:
    """slide_id, __part, __root of block components that meet others; the root is the component's first pixel."""
    seams = _seams(parts, connectivity, block)
    node = lambda c: F.struct("slide_id", F.col(c).alias("part"))
    found = connected(seams.select(node("a").alias("a"), node("b").alias("b")))
    return found.select(F.col("node.slide_id").alias("slide_id"), F.col("node.part").alias("__part"), F.col("root.part").alias("__root"))


def _sized(df: DataFrame, mask: str, connectivity: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Pixels with their block's component, and slide_id, __part, label, area: a row a block's component."""
    parts = stored(_labelled(df, mask, connectivity, block, []))
    areas = parts.where("__part is not null").groupBy("slide_id", "__part").agg(F.count(F.lit(1)).alias("own"))
    named = stored(areas.join(_roots(parts, connectivity, block), ["slide_id", "__part"], "left").withColumn("label", F.coalesce("__root", "__part")).drop("__root"))
    whole = named.groupBy("slide_id", "label").agg(F.sum("own").alias("area"))
    return parts, named.drop("own").join(whole, ["slide_id", "label"])


def label_components(df: DataFrame, mask: str, connectivity: int = 8, name: str = "label", block: int = BLOCK) -> DataFrame:
    """Adds each mask pixel's component, named by its first pixel (r * CODE + c), null outside."""
    parts, named = _sized(df, mask, connectivity, block)
    found = parts.where("__part is not null").join(named, ["slide_id", "__part"]).select("slide_id", "r", "c", F.col("label").alias(name))
    return df.drop(name).join(found, ["slide_id", "r", "c"], "left")


def by_area(df: DataFrame, mask: str, keep: Column, name: str, connectivity: int = 4, block: int = BLOCK) -> DataFrame:
    """The mask's components whose ``area`` fulfils a condition."""
    parts, named = _sized(df, mask, connectivity, block)
    kept = parts.where("__part is not null").join(named.where(keep), ["slide_id", "__part"], "left_semi").select("slide_id", "r", "c", F.lit(True).alias("__of_size"))
    return df.join(kept, ["slide_id", "r", "c"], "left").withColumn(name, F.coalesce("__of_size", F.lit(False))).drop("__of_size")


def remove_small(df: DataFrame, mask: str, least: int = 64, name: str | None = None, connectivity: int = 4, block: int = BLOCK) -> DataFrame:
    return by_area(df, mask, F.col("area") >= least, name or mask, connectivity, block)


def remove_large(df: DataFrame, mask: str, most: int, name: str | None = None, connectivity: int = 4, block: int = BLOCK) -> DataFrame:
    return by_area(df, mask, F.col("area") <= most, name or mask, connectivity, block)


def fill_holes(df: DataFrame, mask: str, least: int = 64, name: str | None = None, connectivity: int = 4, block: int = BLOCK) -> DataFrame:
    """Background components of fewer than ``least`` pixels are filled."""
    small = by_area(df.withColumn("__hole", ~F.col(mask)), "__hole", F.col("area") < least, "__small", connectivity, block)
    return small.withColumn(name or mask, F.col(mask) | F.col("__small")).drop("__hole", "__small")


def fat_like(df: DataFrame, mask: str, cell: int = 64, kernel: int = 3, keep: int = 1000, name: str = "fat", block: int = BLOCK) -> DataFrame:
    """Tissue around many small holes: what filling adds, without specks under 9, dilated; objects over ``keep`` pixels."""
    filled = fill_holes(df, mask, cell, "__filled", block=block).withColumn("__added", F.col("__filled") & ~F.col(mask))
    grown = dilate(remove_small(filled, "__added", 9, block=block), "__added", kernel, "__grown", block)
    return remove_small(grown, "__grown", keep + 1, name, block=block).drop("__filled", "__added", "__grown")


def region_statistics(df: DataFrame, mask: str, connectivity: int = 8, prefix: str = "", block: int = BLOCK) -> DataFrame:
    """slide_id, num_regions, mean_area, max_area, min_area of a mask's components; zeros where there are none."""
    _, named = _sized(df, mask, connectivity, block)
    sizes = named.select("slide_id", "label", "area").distinct()
    found = sizes.groupBy("slide_id").agg(F.count(F.lit(1)).alias("num_regions"), F.avg("area").alias("mean_area"), F.max("area").alias("max_area"), F.min("area").alias("min_area"))
    kinds = {"num_regions": "long", "mean_area": "double", "max_area": "long", "min_area": "long"}
    return df.select("slide_id").distinct().join(found, "slide_id", "left").select("slide_id", *[F.coalesce(k, F.lit(0)).cast(t).alias(prefix + k) for k, t in kinds.items()])
