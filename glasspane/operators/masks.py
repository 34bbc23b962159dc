"""Masks as boolean columns: thresholds, mask algebra and mask statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import gray, gray8, spread_between

NOT_COMPUTABLE = -100.0


def intensity(lower: float | None = None, upper: float | None = None, lower_std: float | None = None, upper_std: float | None = None, invert: bool = False) -> Column:
    """Pixels whose luminance and channel spread lie strictly between the bounds."""
    inside = F.lit(True)
    if lower is not None:
        inside = inside & (gray() > lower)
    if upper is not None:
        inside = inside & (gray() < upper)
    inside = inside & spread_between(lower_std, upper_std)
    return ~inside if invert else inside


def statistic(mode: str, before: Column, after: Column, total: Column) -> Column:
    """One mask statistic of pixel counts: removed share of the mask, remaining share of the image, or pixels."""
    if mode == "relative2mask":
        return F.when(before == 0, NOT_COMPUTABLE).otherwise(1 - F.try_divide(after, before))
    if mode == "relative2image":
        return F.try_divide(after, total)
    if mode == "absolute":
        return after.cast("double")
    raise ValueError(f"no such mask statistic: {mode}")


def measured(df: DataFrame, steps: list[str], mode: str = "relative2mask", by: str = "slide_id") -> DataFrame:
    """The statistic of a chain of masks, each against the one before it, in a single aggregate per slide."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(s)).alias(s) for s in steps])
    before = [F.col("total"), *[F.col(s) for s in steps[:-1]]]
    return counts.select(by, *[statistic(mode, b, F.col(s), F.col("total")).alias(s) for b, s in zip(before, steps)])


def forced_out(use: Column, *masks: Column) -> Column:
    """The final mask without the masks that are always taken off."""
    for m in masks:
        use = use & ~m
    return use


def otsu_levels(df: DataFrame, value: Column, bins: int = 256) -> DataFrame:
    """slide_id, threshold: the bin centre that parts the values of each slide with the greatest variance between."""
    valued = df.select("slide_id", value.alias("v"))
    ends = valued.groupBy("slide_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    placed = valued.join(ends, "slide_id").withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0) * bins)).cast("int"))
    counted = placed.groupBy("slide_id", "low", "high", "bin").agg(F.count(F.lit(1)).alias("n"))
    # at most `bins` rows a slide, gathered as one map: no further exchange
    every = counted.groupBy("slide_id", "low", "high").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))
    spread = every.select("slide_id", "low", "high", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("h", b), F.lit(0)))).alias("bin", "n"))
    centre = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins
    w = "over (partition by slide_id order by bin rows unbounded preceding)"
    cum = spread.withColumn("centre", centre).selectExpr("slide_id", "bin", "centre", f"sum(n) {w} as w1", f"sum(n * centre) {w} as s1", "sum(n) over (partition by slide_id) as w", "sum(n * centre) over (partition by slide_id) as s")
    left, right = F.try_divide("s1", "w1"), F.try_divide(F.col("s") - F.col("s1"), F.col("w") - F.col("w1"))
    between = F.round(F.col("w1") * (F.col("w") - F.col("w1")) * (left - right) * (left - right), 4)
    scored = cum.withColumn("between", F.coalesce(between, F.lit(-1.0)))
    return scored.groupBy("slide_id").agg(F.max_by("centre", F.struct(F.col("between"), -F.col("bin"))).alias("threshold"))


def otsu(df: DataFrame, invert: bool = False, name: str = "mask") -> DataFrame:
    """Pixels darker than their slide's Otsu threshold."""
    with_level = df.join(otsu_levels(df, gray()), "slide_id")
    dark = gray() < F.col("threshold")
    return with_level.withColumn(name, ~dark if invert else dark)


def equalised(df: DataFrame) -> DataFrame:
    """Each pixel's luminance byte replaced by its cumulative share in the slide (through the slide's histogram)."""
    h = df.groupBy("slide_id", gray8().alias("g")).agg(F.count(F.lit(1)).alias("n"))
    cdf = h.selectExpr("slide_id", "g", "sum(n) over (partition by slide_id order by g) / sum(n) over (partition by slide_id) as equalised")
    return df.withColumn("g", gray8()).join(cdf, ["slide_id", "g"]).drop("g")


def overlaid(df: DataFrame, mask: str) -> DataFrame:
    """over_red, over_green, over_blue: the luminance as green, with the mask as red and blue."""
    m = F.when(F.col(mask), 255).otherwise(0)
    return df.select("slide_id", "r", "c", m.alias("over_red"), gray8().alias("over_green"), m.alias("over_blue"))


def bright_cluster_level(df: DataFrame, start: tuple[float, float, float] = (0.25, 0.5, 0.75), rounds: int = 5) -> DataFrame:
    """slide_id, level: least luminance of the brightest of three clusters (Lloyd's rounds from fixed centres).

    Clustering runs on each slide's histogram of distinct luminances, not on its pixels.
    """
    h = df.groupBy("slide_id", gray().alias("v")).agg(F.count(F.lit(1)).alias("n"))
    grouped = h.groupBy("slide_id").agg(F.collect_list(F.struct("v", "n")).alias("h"))
    state = grouped.withColumn("k", F.array(*map(F.lit, start)))
    nearest = lambda v, k: F.when((F.abs(v - k[0]) <= F.abs(v - k[1])) & (F.abs(v - k[0]) <= F.abs(v - k[2])), 0).when(F.abs(v - k[1]) <= F.abs(v - k[2]), 1).otherwise(2)

    def centre(h: Column, k: Column, j: int) -> Column:
        own = F.filter(h, lambda x: nearest(x["v"], k) == j)
        n = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        s = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["v"] * x["n"])
        return F.when(n == 0, F.get(k, F.lit(j))).otherwise(F.round(F.try_divide(s, n), 9))

    for _ in range(rounds):
        state = state.withColumn("k", F.array(*[centre(F.col("h"), F.col("k"), j) for j in range(3)]))
    bright = F.filter("h", lambda x: nearest(x["v"], F.col("k")) == 2)
    return state.select("slide_id", F.array_min(F.transform(bright, lambda x: x["v"])).alias("level"))
