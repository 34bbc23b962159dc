"""Metric tables as text: reading with inference, writing with headers, batches, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ranked

PLACEHOLDERS = {"embed_x": "double", "embed_y": "double", "groupid": "int", "testind": "int"}
NAMED = ("sitecol", "labelcol")
MARK = "#dataset:"


def listed(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """path: the first field of each line that is no comment, under a base folder; a metric table will do."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    name = F.split("value", "\t")[0]
    return lines.select(F.concat(F.lit(base.rstrip("/") + "/" if base else ""), name).alias("path"))


def globbed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files under a folder by pattern, with length and time; contents are read only if asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The header lines and the column names of a metric table."""
    lines = [r[0] for r in spark.read.text(path).where(F.col("value").startswith("#")).limit(100).collect()]
    names = next((x for x in lines if x.startswith(MARK)), MARK)
    return [x for x in lines if not x.startswith(MARK)], names[len(MARK) :].strip().split("\t")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metric table with an id, numeric columns where all values are numbers or blank, and the review's placeholders."""
    _, names = header(spark, path)
    body = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    fields = body.select(F.split("value", "\t").alias("f"))
    table = fields.select(*[F.nullif(F.get("f", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])
    bad = table.agg(*[F.count_if(F.col(f"`{n}`").isNotNull() & F.expr(f"try_cast(`{n}` as double)").isNull()).alias(n) for n in names]).first()
    typed = table.select(*[F.col(f"`{n}`").cast("double").alias(n) if bad[n] == 0 else F.col(f"`{n}`") for n in names])
    return typed.withColumns({"id": F.monotonically_increasing_id(), **{n: F.lit(None).cast(t) for n, t in PLACEHOLDERS.items() if n not in names}, **{n: F.lit("None") for n in NAMED if n not in names}})


def wide(long: DataFrame, names: list[str]) -> DataFrame:
    """(slide_id, name, value) as one row a slide with the given columns; a missing metric is null, never shifted."""
    return long.groupBy("slide_id").pivot("name", names).agg(F.first("value"))


def long(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """slide_id, pos, name, value (text), num."""
    rows = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value"), F.expr(f"try_cast({n} as double)").alias("num")) for k, n in enumerate(names)])
    return df.select(F.col(key).alias("slide_id"), F.explode(rows).alias("x")).select("slide_id", "x.*")


def joined_warnings(warnings: str = "warnings") -> Column:
    """Warnings as one text, with the empty first element that marks the column's start."""
    return F.concat_ws("|", F.concat(F.array(F.lit("")), F.coalesce(F.col(warnings), F.array().cast("array<string>"))))


def batched(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch: rows in order, ``size`` to a batch. Ranks come from counts per range, not from one task."""
    return ranked(df, [F.col(order)], "__place").withColumn("batch", F.expr(f"(__place - 1) div {size}")).drop("__place")


def unfinished(slides: DataFrame, done: DataFrame, key: str = "slide_id") -> DataFrame:
    """The slides that have no result yet."""
    return slides.join(done.select(key), key, "left_anti")


def export(df: DataFrame, path: str, head: list[str], names: list[str], append: bool = False) -> None:
    """Writes a metric table as tab-separated text: header lines, the column line, then the rows, in one folder."""
    rows = df.select(F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]).alias("value"))
    lines = [] if append else [*head, f"{MARK}\t" + "\t".join(names)]
    if lines:
        df.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    rows.write.mode("append").text(path)


def training_colours(spark: SparkSession, path: str) -> DataFrame:
    """label, red, green, blue from a tab-separated table with a header, class first."""
    return spark.read.option("sep", "\t").option("header", True).schema("label int, red double, green double, blue double").csv(path)


def exemplars(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pixels of example pictures with the label of their mask picture: any brightness is 1."""
    from .pixels import from_images

    found = []
    for k, (picture, mask) in enumerate(pairs):
        marks = from_images(spark, mask).select("r", "c", (F.greatest("red", "green", "blue") > 0).cast("int").alias("label"))
        found.append(from_images(spark, picture).drop("slide_id").join(marks, ["r", "c"]).withColumn("slide_id", F.lit(k).cast("long")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def split_pairs(text: str) -> list[tuple[str, str]]:
    """Lines of picture:mask; the colon of a drive letter does not part them."""
    import re

    return [tuple(re.split(r":(?![\\/])", line.strip(), maxsplit=1)) for line in text.split("\n") if line.strip()]


def template_histograms(spark: SparkSession, folder: str, bins: int = 20) -> DataFrame:
    """template (the file's stem), channel, bin, density of pictures in a folder."""
    from ..operators.stats import histogram
    from .pixels import from_images

    return histogram(from_images(spark, folder), bins).select(F.regexp_replace("slide_id", r"\.[^.]*$", "").alias("template"), "channel", "bin", "density")
