"""Queries on the table of slide metrics: selections, sorting, paging, group totals, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ranked
from .aggregators import aggregated
from .annotations import crosses

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def numeric_if_all(df: DataFrame, column: str) -> Column:
    """A text as a number where it is one."""
    return F.expr(f"try_cast(trim({column}) as double)")


# --- selections -----------------------------------------------------------------------------


def brush(ranges: dict[str, list[tuple[float, float]]], together: str = "and") -> Column:
    """Rows in a range of each brushed axis (or of any, for "or"); an axis may have several; no brush keeps all."""
    axes = [reduce(lambda a, b: a | b, [F.col(c).between(low, high) for low, high in r]) for c, r in ranges.items() if r]
    if not axes:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if together == "and" else (lambda a, b: a | b), axes)


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds each column's place between its least and greatest value, as __<column>; constants lie in the middle."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    placed = df.join(F.broadcast(ends))  # a single row
    for c in columns:
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        placed = placed.withColumn(f"__{c}", F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), width), F.lit(0.5)))
    return placed.drop(*[f"{n}_{c}" for c in columns for n in ("lo", "hi")])


def strum(df: DataFrame, left: str, right: str, line: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """Rows whose segment from the left axis (x = 0) to the right one (x = 1) crosses a drawn line."""
    (x1, y1), (x2, y2) = sorted(line)
    at = lambda x: F.col(f"__{left}") + (F.col(f"__{right}") - F.col(f"__{left}")) * x
    return scaled(df, [left, right]).where((at(x1) - y1) * (at(x2) - y2) <= 0).select(*df.columns)


def angular(df: DataFrame, left: str, right: str, low: float, high: float) -> DataFrame:
    """Rows whose segment between two axes rises at an angle (radians) between the bounds."""
    slope = F.atan2(F.col(f"__{right}") - F.col(f"__{left}"), F.lit(1.0))
    return scaled(df, [left, right]).where(slope.between(low, high)).select(*df.columns)


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a drawn polygon, as one expression; fewer than three corners select everything."""
    if len(polygon) < 3:
        return F.lit(True)
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x2 - x1) * (y - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1))
            hits = hits + hit.cast("int")
    return hits % 2 == 1


#: Edges of a drawing.
MOST_EDGES = 10_000


def lasso_ids(df: DataFrame, key: str, x: str, y: str, polygon: DataFrame) -> DataFrame:
    """key of rows in polygons given as edges (x1, y1, x2, y2): a drawing, of MOST_EDGES edges at most, is broadcast."""
    if polygon.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"a drawing of over {MOST_EDGES} edges")
    met = df.select(key, x, y).join(F.broadcast(polygon), crosses(F.col(x), F.col(y)))
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key)


# --- sorting and paging ------------------------------------------------------------------------


def ordered(df: DataFrame, column: str, key: str, ascending: bool = True, as_text: bool = False) -> DataFrame:
    """Sorted by a column; ties keep the order of the key."""
    value = F.col(column).cast("string") if as_text else F.col(column)
    return df.orderBy(value.asc_nulls_first() if ascending else value.desc_nulls_last(), key)


#: Rows up to which a page is the end of a top-k; later ones are found by numbering the rows.
EARLY = 10_000


def page(df: DataFrame, column: str, key: str, number: int, size: int = 25, ascending: bool = True) -> DataFrame:
    """One page of a sorted table; a page beyond the last shows the last.

    Up to row EARLY it is a top-k of each task's rows, and nothing is stored. Beyond, rows are numbered by ranges (``ranked``), so a
    late page costs what any other late one does and no task holds those before it.
    """
    pages = max(1, -(-df.count() // size))
    at = min(max(0, number), pages - 1)
    value = F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()
    if (at + 1) * size <= EARLY:
        return df.orderBy(value, F.col(key)).offset(at * size).limit(size)
    shown = ranked(df, [value, F.col(key)], "__place").where(F.col("__place").between(at * size + 1, (at + 1) * size))
    return shown.orderBy("__place").select(*df.columns)


def row_numbers(df: DataFrame, key: str) -> DataFrame:
    """The table with row, each key's place from 0 in the order of keys: both ways between ids and rows are a join or filter."""
    return ranked(df, [F.col(key)], "row").withColumn("row", F.col("row") - 1)


def random_subset(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (or all) drawn by a hash of the key: the same ones on every run, and a top-k rather than a shuffle of all."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), key).limit(n)


# --- totals and summaries -------------------------------------------------------------------------


def totals(column: str, name: str | None = None) -> list[Column]:
    """avg, min, max, sum of what is a number in a column, and the number of rows."""
    value, n = F.expr(f"try_cast({column} as double)"), name or column
    own = F.when(~F.isnan(value), value)
    return [F.avg(own).alias(f"avg_{n}"), F.min(own).alias(f"min_{n}"), F.max(own).alias(f"max_{n}"), F.coalesce(F.sum(own), F.lit(0.0)).alias(f"sum_{n}"), F.count(F.lit(1)).alias(f"count_{n}")]


def group_totals(df: DataFrame, by: list[str], columns: list[str], nested: bool = False) -> DataFrame:
    """Totals per group; nested: for every level of the grouping as well."""
    grouped = df.rollup(*by) if nested else df.groupBy(*by)
    aggregates = [a for c in columns for a in totals(c)]
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *aggregates) if nested else grouped.agg(*aggregates)


def ordered_groups(df: DataFrame, by: str, aggregators: dict[str, Column], values: list | None = None, order: list[Column] | None = None, stateful: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Groups of a column with any aggregates by name; values: groups that are shown even where they are empty, and no others.

    stateful: name -> (registered aggregator, column), see ``aggregators``.

    order: what groups are compared by, aggregates included; place (from 1) is a group's place.
    """
    grouped = df.groupBy(by).agg(*[a.alias(n) for n, a in aggregators.items()])
    if stateful:
        more = aggregated(df, by, stateful)
        grouped = grouped.join(more.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    if values is not None:
        fixed = df.sparkSession.createDataFrame([(v,) for v in values], f"{by} {df.schema[by].dataType.simpleString()}")
        grouped = fixed.join(grouped, by, "left")
    return ranked(grouped, [*(order or []), F.col(by)])


def axis_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """axis, count, mean, std (of the sample), min, max; mean and std to three places."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return rows.groupBy("axis").agg(F.count("v").alias("count"), F.round(F.avg("v"), 3).alias("mean"), F.round(F.stddev_samp("v"), 3).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def nice_step(low: float, high: float, about: int) -> float:
    """A step of 1, 2 or 5 times a power of ten that gives about so many ticks."""
    import math

    raw = (high - low) / max(1, about)
    if raw <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(raw))
    part = raw / power
    return power * (10 if part >= 50**0.5 else 5 if part >= 10**0.5 else 2 if part >= 2**0.5 else 1)


def violin_histogram(df: DataFrame, column: str, step: float) -> DataFrame:
    """bin (its lower end), n."""
    return df.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / F.lit(step)).alias("k")).agg(F.count(F.lit(1)).alias("n")).select((F.col("k") * F.lit(step)).alias("bin"), "n")


def kernel_density(df: DataFrame, column: str, ticks: list[float], width: float = 0.3) -> DataFrame:
    """tick, density: the Epanechnikov estimate at each tick, in one pass without meeting every tick.

    Equal values are counted first; each value then reaches only the ticks within its width.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    rows = df.agg(F.count(column).alias("rows"))
    at = F.array(*map(F.lit, ticks))
    near = counted.select("v", "m", F.explode(F.filter(at, lambda t: F.abs(t - F.col("v")) <= width)).alias("tick"))
    u = (F.col("tick") - F.col("v")) / width
    sums = near.groupBy("tick").agg(F.sum(F.col("m") * 0.75 * (1 - u * u) / width).alias("s"))
    every = df.sparkSession.range(1).select(F.explode(at).alias("tick"))
    return every.join(sums, "tick", "left").join(F.broadcast(rows)).select("tick", F.try_divide(F.coalesce("s", F.lit(0.0)), F.col("rows")).alias("density"))


def extents(df: DataFrame, columns: list[str], common: bool = False) -> DataFrame:
    """axis, low, high; common: all axes share one scale."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    own = rows.groupBy("axis").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    if not common:
        return own
    return own.select("axis").join(F.broadcast(own.agg(F.min("low").alias("low"), F.max("high").alias("high"))))


def by_frequency(df: DataFrame, column: str) -> DataFrame:
    """value, n, place: the values of a text axis, the most frequent first."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return ranked(counted, [-F.col("n"), F.col("value")])


def bundle_centroids(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def axis_order(df: DataFrame, key: str, value, columns: list[str]) -> DataFrame:
    """place, axis: the axes in order of one row's values."""
    row = df.where(F.col(key) == value).limit(1)
    pairs = F.array_sort(F.array(*[F.struct(F.col(c).cast("double").alias("v"), F.lit(c).alias("axis")) for c in columns]))
    return row.select(F.posexplode(pairs).alias("place", "x")).select("place", "x.axis")
