"""Slide metadata: property bags, magnification, the grammar of working sizes, bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a size may look like; other texts are invalid (a fixed value).
SIZE = r"^\d?\.?\d*[xX]?$"


def prop(name: str, bag: str = "properties") -> Column:
    return F.element_at(bag, name)


#: Basic statistics and the properties they show (fixed values).
BASIC = {
    "type": "openslide.vendor",
    "levels": "openslide.level-count",
    "height": "openslide.level[0].height",
    "width": "openslide.level[0].width",
    "mpp_x": "openslide.mpp-x",
    "mpp_y": "openslide.mpp-y",
    "comment": "openslide.comment",
}
MAGNIFICATIONS = ("openslide.objective-power", "aperio.AppMag")


def basic(df: DataFrame, key: str = "slide_id") -> DataFrame:
    """The seven basic statistics, NA where a property is missing; line breaks in the comment become spaces."""
    shown = {n: F.coalesce(prop(p), F.lit("NA")) for n, p in BASIC.items()}
    shown["comment"] = F.translate(shown["comment"], "\r\n", "  ")
    return df.select(key, *[c.alias(n) for n, c in shown.items()])


def identity(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("filename", F.element_at(F.split(path, "/"), -1)).withColumn("comments", F.lit(" "))


def magnification(default: float | None = None, bag: str = "properties") -> Column:
    """The slide's own magnification, by the first property that is a number, else the default."""
    own = [F.expr(f"try_cast({bag}['{p}'] as double)") for p in MAGNIFICATIONS]
    return F.coalesce(*own, F.lit(default).cast("double"))


def bounds(bag: str = "properties") -> Column:
    """struct(x, y, w, h) from the bounds properties, or null if any is missing or no whole number."""
    parts = {n: F.expr(f"try_cast({bag}['openslide.bounds-{p}'] as int)") for n, p in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))}
    whole = F.lit(True)
    for c in parts.values():
        whole = whole & c.isNotNull()
    return F.when(whole, F.struct(*[c.alias(n) for n, c in parts.items()]))


def working_size(text: Column, width: Column, height: Column, base: Column, level_factors: Column | None = None) -> Column:
    """struct(kind, factor, level, width, height) of a size text: magnification, factor, level or pixels; null if invalid."""
    t = F.trim(text)
    ok = t.rlike(SIZE) & t.rlike(r"\d")
    n = F.regexp_replace(t, "[xX]$", "").try_cast("double")
    by_power = F.upper(t).endswith("X")
    factor = F.when(by_power, F.try_divide(base, n)).when(n < 1, F.try_divide(F.lit(1.0), n)).when(n >= 100, F.try_divide(F.greatest(width, height).cast("double"), n))
    cut = (n >= 100) & ~by_power
    dim = lambda x: F.when(cut, F.when(x == F.greatest(width, height), n).otherwise(F.floor(F.try_divide(x.cast("double"), factor)))).otherwise(F.bround(F.try_divide(x.cast("double"), factor)))
    kind = F.when(by_power, "magnification").when(n < 1, "factor").when(n < 100, "level").otherwise("pixels")
    last = F.size(level_factors) - 1 if level_factors is not None else F.lit(0)
    level = F.when(kind == "level", F.least(n.cast("int"), last))
    return F.when(ok, F.struct(kind.alias("kind"), factor.alias("factor"), level.alias("level"), dim(width).cast("int").alias("width"), dim(height).cast("int").alias("height")))


def nearest_level(factor: Column, level_factors: Column, tolerance: float = 0.01) -> Column:
    """struct(level, exact): a level within 1 % of the factor, else the coarsest one that is fine enough."""
    exact = F.array_position(F.transform(level_factors, lambda f: F.abs(f - factor) <= tolerance * factor), True).cast("int")
    enough = F.size(F.filter(level_factors, lambda f: f <= factor))
    return F.struct(F.when(exact > 0, exact - 1).otherwise(F.greatest(enough - 1, F.lit(0))).alias("level"), (exact > 0).alias("exact"))
