"""Grouped maps over slides, for kernels that need a slide's whole raster; slides are independent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels


#: What a row counts in the number of a pixel; no raster is wider.
CODE = 1 << 31


def per_slide(df: DataFrame, function: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], inputs: list[str], outputs: dict[str, str]) -> DataFrame:
    """All columns of df and the outputs that the function makes of a slide's rasters (missing pixels: 0 or false).

    With df already dealt by slide there is no further exchange. Where df has a column __failed, a slide whose function
    raises keeps the message there and has empty outputs, and later steps leave it out.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name not in outputs] + [T.StructField(k, T._parse_datatype_string(t)) for k, t in outputs.items()])
    names, guarded = [f.name for f in schema.fields], "__failed" in df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r, c = r - r.min(), c - c.min()
        shape = (int(r.max()) + 1, int(c.max()) + 1)
        rasters = {"present": np.zeros(shape, bool)}
        rasters["present"][r, c] = True
        for name in inputs:
            values = pdf[name].to_numpy()
            rasters[name] = np.zeros(shape, values.dtype if values.dtype != object else bool)
            rasters[name][r, c] = values
        try:
            made = function(rasters) if not guarded or pd.isna(pdf["__failed"].iloc[0]) else None
        except Exception as e:  # the slide's own failure is its result
            if not guarded:
                raise
            made, pdf = None, pdf.assign(__failed=f"{type(e).__name__}: {e}")
        if made is None:
            made = {k: np.zeros(shape, bool if t == "boolean" else float if t == "double" else int) for k, t in outputs.items()}
        return pdf.assign(**{k: made[k][r, c] for k in outputs})[names]

    return df.groupBy("slide_id").applyInPandas(run, schema)


def mask_kernel(df: DataFrame, mask: str, kernel: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    return per_slide(df, lambda x: {name: kernel(x[mask]) & x["present"]}, [mask], {name: "boolean"})


def remove_small(df: DataFrame, mask: str, least: int = 64, name: str | None = None, connectivity: int = 4) -> DataFrame:
    return mask_kernel(df, mask, lambda m: kernels.without_small(m, least, connectivity), name or mask)


def remove_large(df: DataFrame, mask: str, most: int, name: str | None = None, connectivity: int = 4) -> DataFrame:
    return mask_kernel(df, mask, lambda m: kernels.without_large(m, most, connectivity), name or mask)


def fill_holes(df: DataFrame, mask: str, least: int = 64, name: str | None = None, connectivity: int = 4) -> DataFrame:
    return per_slide(df, lambda x: {name or mask: kernels.filled(x[mask] | ~x["present"], least, connectivity) & x["present"]}, [mask], {name or mask: "boolean"})


def fat_like(df: DataFrame, mask: str, cell: int = 64, kernel: int = 3, keep: int = 1000, name: str = "fat") -> DataFrame:
    """Tissue around many small holes: what filling adds, without specks under 9, dilated; objects over ``keep`` pixels."""

    def run(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        m = x[mask]
        added = kernels.filled(m | ~x["present"], cell) & ~m & x["present"]
        grown = kernels.dilated(kernels.without_small(added, 9), kernels.square(kernel)) & x["present"]
        return {name: kernels.without_small(grown, keep + 1)}

    return per_slide(df, run, [mask], {name: "boolean"})


def open_disk(df: DataFrame, mask: str, radius: int = 25, name: str | None = None) -> DataFrame:
    return per_slide(df, lambda x: {name or mask: kernels.opened(x[mask] | ~x["present"], radius) & x[mask]}, [mask], {name or mask: "boolean"})


def label_components(df: DataFrame, mask: str, connectivity: int = 8, name: str = "label") -> DataFrame:
    """Adds each mask pixel's component, named by its first pixel (r * CODE + c of the least), null outside."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, m = pdf["r"].to_numpy(), pdf["c"].to_numpy(), pdf[mask].to_numpy().astype(bool)
        raster = np.zeros((int(r.max()) + 1, int(c.max()) + 1), bool)
        raster[r, c] = m
        labels = kernels.label(raster, connectivity)[r, c]
        code = r.astype(np.int64) * CODE + c
        first = np.full(labels.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, labels, code)
        return pdf.assign(**{name: pd.Series(first[labels], index=pdf.index).astype("Int64").where(pd.Series(m, index=pdf.index))})

    return df.groupBy("slide_id").applyInPandas(run, schema)


def region_statistics(df: DataFrame, mask: str, connectivity: int = 8, prefix: str = "") -> DataFrame:
    """slide_id, num_regions, mean_area, max_area, min_area of a mask's components; zeros where there are none."""
    labelled = label_components(df, mask, connectivity)
    sizes = labelled.groupBy("slide_id", "label").agg(F.count(F.lit(1)).alias("area"))
    real = F.col("label").isNotNull()
    own = lambda f: F.coalesce(f(F.when(real, F.col("area"))), F.lit(0))
    return sizes.groupBy("slide_id").agg(F.count_if(real).alias(f"{prefix}num_regions"), own(F.avg).cast("double").alias(f"{prefix}mean_area"), own(F.max).cast("long").alias(f"{prefix}max_area"), own(F.min).cast("long").alias(f"{prefix}min_area"))


def blurred(df: DataFrame, value: str, sigma: float, name: str = "blurred") -> DataFrame:
    return per_slide(df, lambda x: {name: kernels.gaussian(x[value], sigma)}, [value], {name: "double"})


def features(df: DataFrame, value: str, wanted: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Adds pixel features (see FEATURES) made of one raster."""
    return per_slide(df, lambda x: {k: f(x[value].astype(float)) for k, f in wanted.items()}, [value], {k: "double" for k in wanted})


def features_with(laplace_size=3, scales=(1, 3, 5, 7, 9), beta=0.5, gamma=15.0, dark_ridges=True, thetas=4, sigmas=(1, 3), frequencies=(0.05, 0.25), lbp_points=24, lbp_radius=3.0, lbp_method="default", median_radius=3, gaussian_sigma=1.0) -> dict[str, Callable[[np.ndarray], np.ndarray]]:
    """Pixel features by name; the angles of the Gabor bank are quarters of half a turn."""
    if laplace_size != 3:
        raise ValueError("the Laplacian is that of the nearest four")
    if lbp_method != "default":
        raise ValueError(f"no such binary pattern: {lbp_method}")
    made: dict[str, Callable[[np.ndarray], np.ndarray]] = {
        "laplace": kernels.laplacian,
        "gaussian": lambda a: kernels.gaussian(a, gaussian_sigma),
        "median": lambda a: kernels.median(a, median_radius),
        "frangi": lambda a: kernels.ridges(a if dark_ridges else -a, scales, beta, gamma),
        "lbp": lambda a: kernels.binary_pattern(a, lbp_points, lbp_radius),
    }
    for t in range(thetas):
        for sigma in sigmas:
            for frequency in frequencies:
                made[f"gabor_{t}_{sigma:g}_{round(frequency * 100):d}" if len({round(f * 100) for f in frequencies}) == len(frequencies) else f"gabor_{t}_{sigma:g}_{frequency:g}"] = lambda a, t=t, s=sigma, f=frequency: kernels.gabor(a, f, t * np.pi / 4, s)
    return made


#: Pixel features by name, as they are without parameters.
FEATURES = features_with()


def pictures(df: DataFrame, columns: list[str]) -> DataFrame:
    """slide_id, png: a picture of each slide, of one boolean column (white where it holds) or of three colours."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1)
        layers = np.zeros((*shape, len(columns)), np.uint8)
        for k, name in enumerate(columns):
            values = pdf[name].to_numpy()
            layers[pdf["r"], pdf["c"], k] = values.astype(bool) * 255 if len(columns) == 1 else values
        return pd.DataFrame({"slide_id": [pdf["slide_id"].iloc[0]], "png": [kernels.png(layers)]})

    return df.select("slide_id", "r", "c", *columns).groupBy("slide_id").applyInPandas(run, T.StructType([df.schema["slide_id"], T.StructField("png", T.BinaryType())]))


#: What an answer is divided by before it is compared, and what it must exceed; darker than this is dark (fixed values).
RIDGE_UNIT, RIDGE_LEAST, DARK = 8.875854409275627e-08, 5.0, 0.3


def ridge_share(df: DataFrame, window: int = 2048, least: int = 0, name: str = "roi", specks: int = 100) -> DataFrame:
    """slide_id and the share of dark ridges among the pixels of all windows.

    Windows start at the slide's corner; what of them lies beyond the slide is black. In each, ridges of ``specks``
    pixels or more are marked; then those of ``least`` or more of the marks of all windows together. A window is
    a task's unit, and marks that touch across windows meet by their seams, so the slide never has to fit in memory.
    """
    from ..functions.colour import gray
    from . import blocks

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["__i"].iloc[0]) * window, int(pdf["__j"].iloc[0]) * window
        a = np.zeros((window, window))
        a[pdf["r"] - i, pdf["c"] - j] = pdf["__g"]
        answer = kernels.ridges(a, (1, 3, 5), 0.5, 100.0) / RIDGE_UNIT
        marked = kernels.without_small((a < DARK) & (answer > RIDGE_LEAST), specks, 4)
        r, c = np.nonzero(marked)
        return pd.DataFrame({"slide_id": pdf["slide_id"].iloc[0], "r": (r + i).astype(np.int32), "c": (c + j).astype(np.int32), "m": True})

    key = df.schema["slide_id"]
    places = df.select("slide_id", "r", "c", gray().alias("__g"), F.expr(f"r div {window}").alias("__i"), F.expr(f"c div {window}").alias("__j"))
    marks = places.groupBy("slide_id", "__i", "__j").applyInPandas(run, T.StructType([key, T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("m", T.BooleanType())]))
    if least > 1:
        marks = blocks.remove_small(marks, "m", least, "m", 4, window).where("m")
    total = places.groupBy("slide_id").agg(((F.max("__i") + 1) * (F.max("__j") + 1) * window * window).alias("__n"))
    found = total.join(marks.groupBy("slide_id").agg(F.count(F.lit(1)).alias("__m")), "slide_id", "left")
    return found.select("slide_id", (F.coalesce("__m", F.lit(0)) / F.col("__n")).alias(name))


def contours(df: DataFrame, mask: str, scale: float = 1.0) -> DataFrame:
    """slide_id, geojson: the mask's outlines as a FeatureCollection (null if it is empty); ids are hashes of the rings."""
    import hashlib
    import json

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raster = np.zeros((int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1), bool)
        raster[pdf["r"], pdf["c"]] = pdf[mask]
        made = []
        for outer, holes in kernels.outline(raster):
            rings = [[[x * scale, y * scale] for x, y in ring] for ring in (outer, *holes)]
            name = hashlib.sha256(json.dumps(rings).encode()).hexdigest()[:32]
            made.append({"type": "Feature", "id": name, "geometry": {"type": "Polygon", "coordinates": rings}, "properties": {"objectType": "annotation"}})
        text = json.dumps({"type": "FeatureCollection", "features": made}) if made else None
        return pd.DataFrame({"slide_id": [pdf["slide_id"].iloc[0]], "geojson": [text]})

    return df.select("slide_id", "r", "c", mask).groupBy("slide_id").applyInPandas(run, T.StructType([df.schema["slide_id"], T.StructField("geojson", T.StringType())]))
