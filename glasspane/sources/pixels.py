"""The canonical pixel relation: one row per pixel of a slide's thumbnail.

A slide is a group of rows of one ``slide_id``; masks are boolean columns beside the channels, and every
operator keeps the partitioning by slide, so a whole pipeline needs one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

SIDE = 64


def u8(x):
    """A value of [-1, 1] as a channel's byte."""
    return F.floor((x.cast("double") + 1.0) * 127.5).cast("int")


def from_vectors(vectors: DataFrame) -> DataFrame:
    """Pixels of slides whose raster rows are vectors: SIDE consecutive vectors make one slide.

    Channels are the vector and its rotations by a third and two thirds.
    """
    spread = vectors.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("c"))
    channel = lambda shift: u8(F.get("embedding", (F.col("c") + shift) % SIDE))
    return spread.select(
        F.expr(f"vec_id div {SIDE}").alias("slide_id"),
        (F.col("vec_id") % SIDE).cast("int").alias("r"),
        "c",
        channel(0).alias("red"),
        channel(SIDE // 3).alias("green"),
        channel(2 * SIDE // 3).alias("blue"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_vectors(table(spark, sf_dir, "embeddings"))


def from_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of image files, read by Spark's image source, which stores bytes as blue, green, red."""
    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    place = F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i")
    spread = images.select(F.element_at(F.split("origin", "/"), -1).alias("slide_id"), "width", "nChannels", "data", place)
    # a single grey channel stands for all three
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + F.least(F.lit(k), F.col("nChannels") - 1) + 1, F.lit(1))), 16, 10).cast("int")
    return spread.select("slide_id", F.expr("cast(i div width as int)").alias("r"), (F.col("i") % F.col("width")).cast("int").alias("c"), byte(2).alias("red"), byte(1).alias("green"), byte(0).alias("blue"))


def flattened(df: DataFrame, alpha: str, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """Pixels with an alpha channel (0 to 255) laid on a background colour."""
    share = F.col(alpha) / 255.0
    return df.withColumns({n: F.bround(F.col(n) * share + b * (1 - share)).cast("int") for n, b in zip(("red", "green", "blue"), background)}).drop(alpha)


def decimated(df: DataFrame, factor: int) -> DataFrame:
    """A thumbnail: the mean of each square of ``factor`` pixels, rounded half to even."""
    means = [F.bround(F.avg(n)).cast("int").alias(n) for n in ("red", "green", "blue")]
    return df.groupBy("slide_id", F.expr(f"r div {factor}").cast("int").alias("r"), F.expr(f"c div {factor}").cast("int").alias("c")).agg(*means)


def cropped(df: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """The pixels of a bounding box, in coordinates of the whole slide; the filter reaches the scan."""
    return df.where(F.col("r").between(top, top + height - 1) & F.col("c").between(left, left + width - 1))
