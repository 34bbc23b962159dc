"""Metrics of slides: brightness, contrast, histograms, texture, stains. One aggregate per slide each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import converted, gray, stain_channels
from .masks import NOT_COMPUTABLE
from .neighbourhood import sobel_squared


def over(mask: str | None, value: Column, invert: bool = False) -> Column:
    """The value where the mask holds (or does not), else null, so aggregates skip it."""
    if mask is None:
        return value
    return F.when(~F.col(mask) if invert else F.col(mask), value)


def brightness(df: DataFrame, space: str | None = None, mask: str | None = None, invert: bool = False, prefix: str = "") -> DataFrame:
    """Mean and population deviation of luminance, or of each channel of a colour space, over the mask (empty: the sentinel, and 0)."""
    values = {f"{prefix}grayscale_brightness": gray()} if space is None else {f"{prefix}chan{k}_brightness": v for k, v in enumerate(converted(space), 1)}
    tail = "" if space in (None, "RGB") else f"_{space}"
    aggregates = []
    for name, value in values.items():
        own = over(mask, value, invert)
        aggregates += [F.coalesce(F.avg(own), F.lit(NOT_COMPUTABLE)).alias(name + tail), F.coalesce(F.stddev_pop(own), F.lit(0.0)).alias(f"{name}_std{tail}")]
    return df.groupBy("slide_id").agg(*aggregates)


def contrast(df: DataFrame, mask: str | None = None, invert: bool = False, prefix: str = "") -> DataFrame:
    """Tenengrad, Michelson and root-mean-square contrast of luminance over the mask."""
    sobel = sobel_squared(df.withColumn("__g", gray()), "__g", "__s2")
    g, s = over(mask, F.col("__g"), invert), over(mask, F.col("__s2"), invert)
    own = sobel.groupBy("slide_id").agg(F.sum(s).alias("s"), F.count(g).alias("n"), F.min(g).alias("low"), F.max(g).alias("high"), F.stddev_pop(g).alias("rms"))
    michelson = F.when(F.col("high") + F.col("low") == 0, 0.0).otherwise(F.try_divide(F.col("high") - F.col("low"), F.col("high") + F.col("low")))
    value = lambda c: F.when(F.col("n") == 0, NOT_COMPUTABLE).otherwise(c)
    return own.select("slide_id", value(F.try_divide(F.sqrt("s"), F.col("n"))).alias(f"{prefix}tenenGrad_contrast"), value(michelson).alias(f"{prefix}michelson_contrast"), value(F.col("rms")).alias(f"{prefix}rms_contrast"))


def histogram(df: DataFrame, bins: int = 20, mask: str | None = None) -> DataFrame:
    """slide_id, channel, bin, density: densities of each channel over 0..255, the last bin closed; zeros for an empty mask."""
    masked = df.select("slide_id", (F.col(mask) if mask else F.lit(True)).alias("__m"), F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).alias("v")) for n in ("red", "green", "blue")])).alias("x"))
    place = F.least(F.floor(F.col("x.v") * bins / 255), F.lit(bins - 1)).cast("int")
    counted = masked.groupBy("slide_id", F.col("x.channel").alias("channel"), place.alias("bin")).agg(F.count_if("__m").alias("n"))
    whole = counted.groupBy("slide_id", "channel").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))  # `bins` entries
    spread = whole.select("slide_id", "channel", "total", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("h", b), F.lit(0)))).alias("bin", "n"))
    density = F.when(F.col("total") == 0, 0.0).otherwise(F.try_divide(F.col("n") * bins, F.col("total") * 255.0))
    return spread.select("slide_id", "channel", "bin", density.alias("density"))


def template_distance(histograms: DataFrame, templates: DataFrame, template: str = "template") -> DataFrame:
    """slide_id, template, distance: summed squared differences of densities. Templates are the smaller side."""
    named = templates.select(template, "channel", "bin", F.col("density").alias("__d"))
    return histograms.join(named, ["channel", "bin"]).groupBy("slide_id", template).agg(F.sum((F.col("density") - F.col("__d")) * (F.col("density") - F.col("__d"))).alias("distance"))


def stains(df: DataFrame, stain: str = "hed", mask: str | None = None, prefix: str = "deconv_") -> DataFrame:
    """Mean and deviation of each stain's concentration: clipped at the slide's 99th percentile, scaled to 0..1 over the mask."""
    named = df
    for k, c in enumerate(stain_channels(stain)):
        named = named.withColumn(f"__c{k}", c)
    use = (F.col(mask) if mask else F.lit(True)).alias("__m")
    cut = named.groupBy("slide_id").agg(*[F.percentile(f"__c{k}", 0.99).alias(f"__q{k}") for k in range(3)])
    clipped = named.join(cut, "slide_id").select("slide_id", use, *[F.least(f"__c{k}", f"__q{k}").alias(f"__c{k}") for k in range(3)])
    aggregates = []
    for k in range(3):
        own = F.when(F.col("__m"), F.col(f"__c{k}"))
        width = F.max(own) - F.min(own)
        scale = F.when(width == 0, F.lit(1.0)).otherwise(width)
        aggregates += [F.coalesce((F.avg(own) - F.min(own)) / scale, F.lit(NOT_COMPUTABLE)).alias(f"{prefix}c{k}_mean"), F.coalesce(F.stddev_pop(own) / scale, F.lit(NOT_COMPUTABLE)).alias(f"{prefix}c{k}_std")]
    return clipped.groupBy("slide_id").agg(*aggregates)


def sampled_corners(df: DataFrame, mask: str | None, patches: int, seed: int = 0) -> DataFrame:
    """slide_id, patch, r0, c0: top-left corners of patches, drawn with replacement from the mask's places.

    Patch i takes the place whose rank (by row, then column) is a hash of seed, slide and i modulo the mask's size. Ranks
    come from counts by row, so that no task orders a whole slide.
    """
    own = (df.where(F.col(mask)) if mask else df).select("slide_id", "r", "c")
    rows = own.groupBy("slide_id", "r").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.selectExpr("*", "sum(n) over (partition by slide_id order by r) - n as before", "sum(n) over (partition by slide_id) as size")
    drawn = rows.select("slide_id", "size").distinct().select("slide_id", "size", F.explode(F.sequence(F.lit(0), F.lit(patches - 1))).alias("patch"))
    rank = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("slide_id"), F.col("patch"))), 1, 15), 16, 10).cast("long") % F.col("size")
    at = drawn.withColumn("rank", rank).join(rows.drop("size"), "slide_id").where("rank >= before and rank < before + n").select("slide_id", "patch", "r", (F.col("rank") - F.col("before") + 1).alias("k"))
    ranked = own.join(at.select("slide_id", "r").distinct(), ["slide_id", "r"], "left_semi").selectExpr("*", "row_number() over (partition by slide_id, r order by c) as k")
    return at.join(ranked, ["slide_id", "r", "k"]).select("slide_id", "patch", F.col("r").alias("r0"), F.col("c").alias("c0"))


#: Rows of a slide that a task of the texture holds at once.
BAND = 64


def texture(df: DataFrame, corners: DataFrame, side: int = 32, levels: int = 8, distance: int = 5) -> DataFrame:
    """slide_id and mean and deviation over patches of the co-occurrence properties, pairs ``distance`` to the right.

    Pairs lie within a row, so patches are counted band by band of BAND rows, and the counts are added; a patch's pixels
    are no rows of their own. Pixels without a shade count as missing.
    """
    import numpy as np
    import pandas as pd

    if side <= distance:
        raise ValueError("a patch must be wider than the distance of its pairs")
    level = F.ceil(F.round(gray() * (levels - 1), 9)).cast("int")
    band = lambda r: F.floor(r / BAND).cast("long")
    shades = df.select("slide_id", "r", "c", level.alias("i"), band(F.col("r")).alias("band")).where("i is not null")
    ends = F.sequence(band(F.col("r0")), band(F.col("r0") + side - 1))
    places = corners.select(F.col("slide_id").alias("of"), "patch", "r0", "c0", F.explode(ends).alias("at"))

    def run(pixels: pd.DataFrame, patches: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = [[], [], [], []]
        if len(pixels) and len(patches):
            r, c, i = (pixels[k].to_numpy() for k in ("r", "c", "i"))
            top, left, kinds = r.min(), c.min(), int(i.max()) + 1
            shade = np.full((r.max() - top + 1, c.max() - left + 1), -1, np.int64)
            shade[r - top, c - left] = i
            one, two = shade[:, :-distance], shade[:, distance:]
            pair = np.where((one >= 0) & (two >= 0), one * kinds + two, kinds * kinds)
            for patch, r0, c0 in zip(*(patches[k].tolist() for k in ("patch", "r0", "c0"))):
                a, b = r0 - top, c0 - left
                own = pair[max(a, 0) : max(a + side, 0), max(b, 0) : max(b + side - distance, 0)]
                n = np.bincount(own.ravel(), minlength=kinds * kinds)[: kinds * kinds].reshape(kinds, kinds)
                n = n + n.T  # a pair counts both ways
                x, y = np.nonzero(n)
                for k, v in enumerate((np.full(len(x), patch), x, y, n[x, y])):
                    found[k].append(v)
        columns = [np.concatenate(v) if v else np.empty(0, np.int64) for v in found]
        key = pixels["slide_id"].iloc[0] if len(pixels) else patches["of"].iloc[0]
        return pd.DataFrame({"slide_id": [key] * len(columns[0]), **dict(zip(("patch", "i", "j", "n"), columns))})

    schema = f"slide_id {df.schema['slide_id'].dataType.simpleString()}, patch long, i long, j long, n long"
    cells = shades.groupBy("slide_id", "band").cogroup(places.groupBy("of", "at")).applyInPandas(run, schema)
    return texture_properties(cells.groupBy("slide_id", "patch", "i", "j").agg(F.sum("n").alias("n")))


def texture_properties(cells: DataFrame) -> DataFrame:
    """From (slide_id, patch, i, j, n): properties per patch, then mean and population deviation per slide."""
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    d = i - j
    sums = cells.groupBy("slide_id", "patch").agg(
        F.sum("n").alias("t"), F.sum(n * d * d).alias("contrast"), F.sum(n * F.abs(d)).alias("dissimilarity"), F.sum(n / (1 + d * d)).alias("homogeneity"), F.sum(n * n).alias("n2"),
        F.sum(n * i).alias("si"), F.sum(n * i * i).alias("sii"), F.sum(n * i * j).alias("sij"),
    )
    t = F.col("t").cast("double")
    mean = F.col("si") / t
    variance = F.col("sii") / t - mean * mean
    correlation = F.when(variance < 1e-15, 1.0).otherwise(F.try_divide(F.col("sij") / t - mean * mean, variance))
    asm = F.col("n2") / (t * t)
    each = sums.select("slide_id", (F.col("contrast") / t).alias("contrast"), (F.col("dissimilarity") / t).alias("dissimilarity"), (F.col("homogeneity") / t).alias("homogeneity"), asm.alias("ASM"), F.sqrt(asm).alias("energy"), correlation.alias("correlation"))
    names = ["contrast", "dissimilarity", "homogeneity", "ASM", "energy", "correlation"]
    return each.groupBy("slide_id").agg(*[f(x).alias(x + tail) for x in names for f, tail in ((F.avg, ""), (F.stddev_pop, "_std"))])
