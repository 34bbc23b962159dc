"""Annotations: GeoJSON and ImageScope XML regions, validation, labels, and masks by point in polygon."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rings import is_simple, simple_parts

POINT = "array<struct<x:int,y:int>>"
REGION = f"outer {POINT}, holes array<{POINT}>, label string, raw_label string, uri string"
FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:struct<classification:struct<name:string>>>"


def _ring(points: Column) -> Column:
    """Pairs of numbers as points, cut to whole pixels."""
    return F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).cast("int").alias("x"), F.get(p, F.lit(1)).cast("int").alias("y")))


def geojson_regions(texts: DataFrame, text: str = "json", uri: str = "uri") -> DataFrame:
    """Regions of GeoJSON texts: a feature, a list of features or a FeatureCollection.

    Polygons (ring 0 outer, the others holes), multi-polygons (a region each) and line strings; other kinds of
    geometry raise an error.
    """
    as_list = F.from_json(text, f"array<{FEATURE}>")
    collection = F.from_json(text, f"struct<features:array<{FEATURE}>>")["features"]
    single = F.array(F.from_json(text, FEATURE))
    head = F.trim(text)
    features = F.when(head.startswith("["), as_list).when(collection.isNotNull(), collection).otherwise(single)
    one = texts.select(F.col(uri).alias("uri"), F.posexplode(features).alias("position", "f"))
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    pair = "array<array<double>>"
    polygons = (
        F.when(kind == "Polygon", F.array(F.from_json(coordinates, f"array<{pair}>")))
        .when(kind == "MultiPolygon", F.from_json(coordinates, f"array<array<{pair}>>"))
        .when(kind == "LineString", F.array(F.array(F.from_json(coordinates, pair))))
        .otherwise(F.raise_error(F.concat(F.lit("geometry cannot be read: "), F.coalesce(kind, F.lit("none")))))
    )
    parts = one.select("uri", "position", F.col("f.properties.classification.name").alias("raw_label"), F.posexplode(polygons).alias("part", "rings"))
    return parts.select("uri", "position", "part", _ring(F.get("rings", F.lit(0))).alias("outer"), F.transform(F.slice("rings", 2, 1 << 20), _ring).alias("holes"), F.col("raw_label").alias("label"), "raw_label")


def xml_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of ImageScope XML files: each Annotation's Regions; holes are ignored."""
    vertex = "array<struct<_X:double,_Y:double>>"
    schema = f"_Name string, Regions struct<Region:array<struct<Vertices:struct<Vertex:{vertex}>>>>"
    read = spark.read.format("xml").option("rowTag", "Annotation").schema(schema).load(path).select("*", F.col("_metadata.file_path").alias("uri"))
    each = read.select("uri", F.col("_Name").alias("raw_label"), F.posexplode("Regions.Region").alias("position", "x"))
    outer = F.transform("x.Vertices.Vertex", lambda p: F.struct(p["_X"].cast("int").alias("x"), p["_Y"].cast("int").alias("y")))
    return each.select("uri", "position", F.lit(0).alias("part"), outer.alias("outer"), F.array().cast(f"array<{POINT}>").alias("holes"), F.col("raw_label").alias("label"), "raw_label")


#: Readers of annotation files by the name of their format.
READERS = {
    "geojson": lambda spark, path: geojson_regions(spark.read.text(path, wholetext=True).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("uri"))),
    "json": lambda spark, path: READERS["geojson"](spark, path),
    "xml": lambda spark, path: xml_regions(spark, path),
}


def regions_by_slide(spark: SparkSession, folder: str, kind: str, suffix: str = "") -> DataFrame | None:
    """Regions of the files <slide><suffix>.<kind> of a folder, with slide_id as text; None for a kind without a reader."""
    if kind.lower() not in READERS:
        return None
    regions = READERS[kind.lower()](spark, f"{folder.rstrip('/')}/*{suffix}.{kind}")
    name = F.element_at(F.split("uri", "/"), -1)
    return regions.withColumn("slide_id", F.substring(name, F.lit(1), F.length(name) - len(f"{suffix}.{kind}")))


def valid(regions: DataFrame) -> DataFrame:
    """Without regions of fewer than three outer points, and without holes of fewer than three points."""
    return regions.where(F.size("outer") >= 3).withColumn("holes", F.filter("holes", lambda h: F.size(h) >= 3))


#: Parts of a region that a repair may give.
PARTS = 1 << 12


def repaired(regions: DataFrame) -> DataFrame:
    """Regions with simple rings only, and ``repaired``: whether a region's rings crossed or touched themselves.

    Such a region becomes the parts of its even-odd area, one or several, each with its holes; crossing points
    are cut to whole pixels as all points are. A region without any area stays as it is. The order of painting is kept: the parts of part p
    are numbered from p * PARTS on.
    """
    names = regions.columns

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                outer, holes = ([[(p["x"], p["y"]) for p in ring] for ring in rings] for rings in ([row["outer"]], row["holes"]))
                row["part"], row["repaired"] = row["part"] * PARTS, False
                if all(is_simple(_open(r)) for r in outer + holes):
                    rows.append(row)
                    continue
                # the outer ring's own area, less what each hole encloses
                parts = simple_parts([_open(outer[0])]) if not holes else simple_parts([_open(r) for r in outer + holes])
                row["repaired"] = True
                as_points = lambda ring: [{"x": int(x), "y": int(y)} for x, y in ring]
                made = [{**row, "part": row["part"] + k, "outer": as_points(o), "holes": [as_points(h) for h in hs]} for k, (o, hs) in enumerate(parts)]
                rows += made or [row]
            yield pd.DataFrame(rows, columns=[*names, "repaired"])

    return regions.mapInPandas(run, T.StructType([*regions.schema.fields, T.StructField("repaired", T.BooleanType())]))


def _open(ring: list) -> list:
    """A ring without its closing point."""
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def relabelled(regions: DataFrame, names: dict[str, str]) -> DataFrame:
    """Labels by a fixed map; a label that the map lacks is an error."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("raw_label"))
    return regions.withColumn("label", F.coalesce(found, F.raise_error(F.concat(F.lit("label is not mapped: "), F.coalesce("raw_label", F.lit("none"))))))


def by_label(regions: DataFrame) -> DataFrame:
    """uri, label, regions: the regions of each label in file order."""
    return regions.groupBy("uri", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "part", "outer", "holes"))), lambda x: F.struct(x["outer"].alias("outer"), x["holes"].alias("holes"))).alias("regions"))


def crosses(x: Column, y: Column) -> Column:
    """Whether the ray to the right of a point crosses the edge x1, y1, x2, y2; an edge owns its lower end."""
    x1, y1, x2, y2 = (F.col(n).cast("double") for n in ("x1", "y1", "x2", "y2"))
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.when(y1 == y2, 1.0).otherwise(y2 - y1) + x1)


def strokes(regions: DataFrame, key: str = "slide_id") -> DataFrame:
    """key, painted (place in the order of painting), value, edge, x1, y1, x2, y2: the edges of all rings, each ring closed.

    Regions are painted in file order, the outer ring with 1 and then each hole with 0; so a region in another's hole
    shows, and regions that overlap unite.
    """
    ring = lambda points, k, value: F.struct(k.cast("int").alias("ring"), F.lit(value).alias("value"), points.alias("points"))
    holes = F.transform("holes", lambda h, i: ring(h, i + 1, 0))
    rings = regions.select(key, *[F.col(c) for c in ("position", "part")], F.explode(F.concat(F.array(ring(F.col("outer"), F.lit(0), 1)), holes)).alias("s"))
    points = F.col("s.points")
    closed = F.concat(points, F.slice(points, 1, 1))
    pairs = F.zip_with(F.slice(closed, F.lit(1), F.size(points)), F.slice(closed, F.lit(2), F.size(points)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return rings.select(key, F.struct("position", "part", F.col("s.ring").alias("ring")).alias("painted"), F.col("s.value").alias("value"), F.posexplode(pairs).alias("edge", "e")).select(key, "painted", "value", "edge", "e.*")


def spans(regions: DataFrame, scale: float = 1.0, key: str = "slide_id") -> DataFrame:
    """key, painted, value, r, low, high: the columns low .. high - 1 of row r that a ring covers, in pixels of ``scale`` slide pixels.

    A ring covers the pixels whose places lie inside it (even-odd, see ``crosses``) and those of its
    outline: on the line between two corners' pixels, a step along the longer axis at a time.
    """
    own = strokes(regions, key)
    y1, y2, x1, x2 = (F.col(n).cast("double") for n in ("y1", "y2", "x1", "x2"))
    rows = F.sequence(F.floor(F.least("y1", "y2") / F.lit(scale)).cast("int"), F.ceil(F.greatest("y1", "y2") / F.lit(scale)).cast("int"))
    y = F.col("r") * F.lit(float(scale))
    crossed = own.where("y1 <> y2").withColumn("r", F.explode(rows)).where((y1 > y) != (y2 > y))
    at = crossed.groupBy(key, "painted", "value", "r").agg(F.array_sort(F.collect_list((x2 - x1) * (y - y1) / (y2 - y1) + x1)).alias("xs"))  # one ring, one row
    ends = F.transform(F.sequence(F.lit(0), F.expr("size(xs) div 2") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))
    column = lambda x: F.ceil(x / F.lit(float(scale))).cast("int")
    inside = at.select(key, "painted", "value", "r", F.explode(ends).alias("s")).select(key, "painted", "value", "r", column(F.col("s.a")).alias("low"), column(F.col("s.b")).alias("high"))
    corner = {n: F.floor(F.col(n) / F.lit(float(scale))).cast("long") for n in ("x1", "y1", "x2", "y2")}
    line = own.select(key, "painted", "value", "edge", *[c.alias(n) for n, c in corner.items()]).withColumn("n", F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))
    on = lambda a, b: F.when(F.col("n") == 0, F.col(a)).otherwise(F.col(a) + F.floor((2 * (F.col(b) - F.col(a)) * F.col("k") + F.col("n")) / (2 * F.greatest("n", F.lit(1))))).cast("int")
    steps = line.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    outline = steps.select(key, "painted", "value", "edge", on("y1", "y2").alias("r"), on("x1", "x2").alias("c")).groupBy(key, "painted", "value", "edge", "r").agg(F.min("c").alias("low"), (F.max("c") + 1).alias("high")).drop("edge")
    return inside.where("low < high").unionByName(outline)


def annotation_mask(df: DataFrame, regions: DataFrame, name: str = "annotated", scale: float = 1.0) -> DataFrame:
    """Pixels that the regions of their slide leave painted (see ``strokes``); regions carry slide_id, and scale is slide pixels to a pixel.

    Pixels join the spans of their own row, an equi-join on slide and row; of the rings over a pixel the last one decides.
    """
    met = df.select("slide_id", "r", "c").join(spans(regions, scale), ["slide_id", "r"]).where("c >= low and c < high")
    inside = met.groupBy("slide_id", "r", "c").agg((F.max_by("value", "painted") == 1).alias(name)).where(name)
    return df.join(inside, ["slide_id", "r", "c"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
