"""Rectangular neighbourhoods as windows over a slide's rows and columns.

Both windows are partitioned within a slide, so pixels dealt by slide need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along_row():
    return Window.partitionBy("slide_id", "r").orderBy("c")


def along_column():
    return Window.partitionBy("slide_id", "c").orderBy("r")


def by_slide(df: DataFrame) -> DataFrame:
    """Deals pixels out by slide, once for all that follows."""
    return df.repartition("slide_id")


def _sides(name: str, w) -> tuple[Column, Column]:
    """Neighbours before and after; at the edge the pixel itself, as a mirror shows it."""
    return F.coalesce(F.lag(name).over(w), F.col(name)), F.coalesce(F.lead(name).over(w), F.col(name))


def box_mean(df: DataFrame, value: str, side: int, name: str = "box_mean") -> DataFrame:
    """Mean over a square of ``side`` pixels, zeros beyond the raster; an even square reaches further back."""
    back, ahead = side // 2, side - 1 - side // 2
    rows = df.withColumn("__row", F.sum(value).over(along_row().rangeBetween(-back, ahead)))
    return rows.withColumn(name, F.sum("__row").over(along_column().rangeBetween(-back, ahead)) / (side * side)).drop("__row")


def extreme(df: DataFrame, value: str, side: int, how: str, name: str) -> DataFrame:
    """Least or greatest value over a square; what lies beyond the raster is ignored."""
    f = {"min": F.min, "max": F.max}[how]
    back, ahead = side // 2, side - 1 - side // 2
    rows = df.withColumn("__row", f(value).over(along_row().rangeBetween(-back, ahead)))
    return rows.withColumn(name, f("__row").over(along_column().rangeBetween(-back, ahead))).drop("__row")


def dilate_square(df: DataFrame, mask: str, side: int, name: str) -> DataFrame:
    return extreme(df.withColumn("__m", F.col(mask).cast("int")), "__m", side, "max", "__d").withColumn(name, F.col("__d") == 1).drop("__m", "__d")


def sobel_squared(df: DataFrame, value: str, name: str = "sobel2") -> DataFrame:
    """Squared gradient magnitude: smoothing by quarters along one axis, half the central difference along the other."""
    before, after = _sides(value, along_row())
    one = df.withColumns({"__d": (after - before) / 2, "__s": (before + 2 * F.col(value) + after) / 4})
    d0, d1 = _sides("__d", along_column())
    s0, s1 = _sides("__s", along_column())
    across, down = (d0 + 2 * F.col("__d") + d1) / 4, (s1 - s0) / 2
    return one.withColumn(name, (across * across + down * down) / 2).drop("__d", "__s")


def laplacian(df: DataFrame, value: str, name: str = "laplacian") -> DataFrame:
    """Sum of the four neighbours less four times the pixel, mirrored at the edge.

    Neighbours are added in the order left, right, up, down: a threshold may fall on a sum's last bit.
    """
    left, right = _sides(value, along_row())
    up, down = _sides(value, along_column())
    return df.withColumn(name, left + right + up + down - 4 * F.col(value))


def flat(df: DataFrame, value: str, side: int = 10, threshold: float = 0.01, name: str = "flat") -> DataFrame:
    """Pixels that differ from their box mean by less than the threshold."""
    return box_mean(df, value, side, "__mean").withColumn(name, F.abs(F.col("__mean") - F.col(value)) < threshold).drop("__mean")


def resized(small: DataFrame, value: str, large_side: int, small_side: int, large: DataFrame, name: str) -> DataFrame:
    """Nearest-neighbour transfer of a column from a small raster to a larger one, by an equi-join on scaled places."""
    scaled = lambda x: F.floor((F.col(x) + 0.5) * small_side / large_side).cast("int")
    source = small.select("slide_id", F.col("r").alias("__r"), F.col("c").alias("__c"), F.col(value).alias(name))
    return large.withColumns({"__r": scaled("r"), "__c": scaled("c")}).join(source, ["slide_id", "__r", "__c"], "left").drop("__r", "__c")


def resized_by_slide(small: DataFrame, value: str, large: DataFrame, name: str) -> DataFrame:
    """The same for slides of any sizes: each axis is scaled by the slide's own extents."""
    sides = lambda df, k: df.groupBy("slide_id").agg((F.max("r") + 1).alias(f"__h{k}"), (F.max("c") + 1).alias(f"__w{k}"))
    both = sides(small, 0).join(sides(large, 1), "slide_id")
    scaled = lambda x, side: F.floor((F.col(x) + 0.5) * F.col(f"{side}0") / F.col(f"{side}1")).cast("int")
    source = small.select("slide_id", F.col("r").alias("__r"), F.col("c").alias("__c"), F.col(value).alias(name))
    placed = large.join(both, "slide_id", "left").withColumns({"__r": scaled("r", "__h"), "__c": scaled("c", "__w")})
    return placed.join(source, ["slide_id", "__r", "__c"], "left").select(*large.columns, name)
