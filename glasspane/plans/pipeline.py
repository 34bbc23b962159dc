"""Pipelines of quality steps: INI text or presets, bound to operators and folded into one plan.

Steps take the state and return it; the masks they make are columns, so all mask statistics of a pipeline come
from one aggregate at the end. Other metrics are stated as functions of the final pixels, which are stored once. Unknown steps and parameters are reported before any work.
"""

from __future__ import annotations

import configparser
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import gray, gray8
from ..operators import annotations, blocks, learning, masks, neighbourhood, raster, stats, tiles
from ..session import stored
from ..sources import tables

Params = dict[str, str]


@dataclass(frozen=True)
class State:
    """Pixels with masks; ``use`` is the present mask. counted: (metric, before, after, mode)."""

    df: DataFrame
    use: str = "use_0"
    mode: str = "relative2mask"
    counted: tuple[tuple[str, str, str, str], ...] = ()
    frames: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    guarded: tuple[tuple[str, str], ...] = ()
    forced: tuple[str, ...] = ()
    done: tuple[str, ...] = ()
    slides: DataFrame | None = None
    templates: DataFrame | None = None
    given: dict[str, DataFrame] = field(default_factory=dict)
    outputs: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = ()
    notes: tuple[str, ...] = ()
    warned: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = ()
    sizes: dict[str, DataFrame] = field(default_factory=dict)
    scale: float = 1.0
    block: int | None = None

    def narrowed(self, use: Column, metric: str | None, mode: str | None = None, warn: str | None = None, df: DataFrame | None = None) -> State:
        name = f"use_{int(self.use.split('_')[1]) + 1}"
        counted = ((metric, self.use, name, mode or self.mode),) if metric else ()
        return replace(self, df=(df if df is not None else self.df).withColumn(name, use), use=name, counted=self.counted + counted, guarded=self.guarded + (((warn, name),) if warn else ()))

    def with_frame(self, frame: Callable[[DataFrame], DataFrame]) -> State:
        return replace(self, frames=(*self.frames, frame))

    def with_output(self, name: str, output: Callable[[DataFrame], DataFrame]) -> State:
        return replace(self, outputs=(*self.outputs, (name, output)))

    def noted(self, text: str) -> State:
        return replace(self, notes=(*self.notes, text))

    def kernel(self, name: str) -> Callable[..., DataFrame]:
        """A kernel over whole slides, or over blocks of them where a slide may be too large for a task."""
        return getattr(raster, name) if self.block is None else partial(getattr(blocks, name), block=self.block)

    def sized(self, size: str | None) -> DataFrame | None:
        """The slides' pixels at another working size, if the caller has given them."""
        return self.sizes.get(size) if size else None

    def own(self, name: str) -> str:
        """A column of the present step alone, so that a step can come twice."""
        return f"__{name}_{len(self.done)}"


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[[State, Params], State]
    params: frozenset[str]


#: Steps by name. Names of their parameters must be those of configuration files (fixed values).
OPERATORS: dict[str, Operator] = {}


def operator(name: str, params: str = ""):
    """Registers a step under its name, with the parameters it reads."""

    def register(run):
        OPERATORS[name] = Operator(name, run, frozenset(params.split()))
        return run

    return register


@dataclass(frozen=True)
class Step:
    name: str
    label: str | None = None
    params: Params = field(default_factory=dict)


def number(p: Params, key: str, default: float | None) -> float | None:
    text = p.get(key)
    if text is None or text.strip() in ("inf", "-inf"):
        return default
    return float(text)


def truth(p: Params, key: str, default: bool) -> bool:
    text = str(p.get(key, default)).strip().lower()
    if text in ("true", "yes", "on", "1", "y", "t"):
        return True
    if text in ("false", "no", "off", "0", "n", "f"):
        return False
    raise ValueError(f"{key} is neither true nor false: {text}")


def mask_of(s: State, p: Params) -> tuple[str | None, bool]:
    limited = truth(p, "limit_to_mask", True)
    name = p.get("mask_name", "img_mask_use").removeprefix("img_mask_")
    own = s.use if name == "use" else f"mask_{name}" if f"mask_{name}" in s.df.columns else name
    return own if limited else None, truth(p, "invert", False)


def prefixed(p: Params) -> str:
    return f"{p['prefix']}_" if p.get("prefix") else ""


@operator("basic_stats")
def basic_stats(s: State, p: Params) -> State:
    from ..sources.slides import basic

    return s if s.slides is None else s.with_frame(lambda df: basic(s.slides))


@operator("intensity", params="name lower_threshold upper_threshold lower_var upper_var lower_std upper_std invert mask_statistics")
def intensity(s: State, p: Params) -> State:
    name = p.get("name", "classTask")
    m = masks.intensity(number(p, "lower_threshold", None), number(p, "upper_threshold", None), number(p, "lower_std", number(p, "lower_var", None)), number(p, "upper_std", number(p, "upper_var", None)), truth(p, "invert", False))
    return s.narrowed(F.col(s.use) & m, name, p.get("mask_statistics"), "intensity")


@operator("otsu", params="name invert local radius mask_statistics")
def otsu(s: State, p: Params) -> State:
    """One threshold for a slide, or (local) for each pixel that of the bytes under a disk around it."""
    if truth(p, "local", False):
        from ..functions import kernels

        limit, radius = s.own("limit"), int(number(p, "radius", 15))
        df = raster.per_slide(s.df.withColumn("__g8", gray8()), lambda x: {limit: kernels.local_otsu(x["__g8"], radius)}, ["__g8"], {limit: "int"})
        dark = F.col("__g8") < F.col(limit)
        mark = s.own("otsu")
        df = df.withColumn(mark, ~dark if truth(p, "invert", False) else dark)
        return s.narrowed(F.col(s.use) & F.col(mark), p.get("name", "otsu"), p.get("mask_statistics"), "otsu", df=df)
    df = masks.otsu(s.df, truth(p, "invert", False), "__otsu")
    return s.narrowed(F.col(s.use) & F.col("__otsu"), p.get("name", "otsu"), p.get("mask_statistics"), "otsu", df=df.drop("threshold"))


@operator("minimum_neighbourhood", params="disk_size upper_threshold invert mask_statistics")
def minimum_neighbourhood(s: State, p: Params) -> State:
    from ..functions import kernels

    radius, limit, invert = int(number(p, "disk_size", 10000)), number(p, "upper_threshold", 200), truth(p, "invert", True)
    grey = s.df.withColumn("__g8", gray8())
    if s.block is None:
        df = raster.per_slide(grey, lambda x: {"__min": kernels.lowest_disk(x["__g8"], radius)}, ["__g8"], {"__min": "int"})
    else:
        df = blocks.lowest(grey, "__g8", radius, "__min", s.block)
    m = F.col("__min") > limit
    return s.narrowed(F.col(s.use) & (~m if invert else m), "brightestPixels", p.get("mask_statistics"), "minimum_neighbourhood", df=df)


@operator("brightest", params="invert mask_statistics")
def brightest(s: State, p: Params) -> State:
    level = s.own("level")
    df = s.df.join(masks.bright_cluster_level(s.df).select("slide_id", F.col("level").alias(level)), "slide_id")
    m = gray() > F.coalesce(level, F.lit(2.0))
    return s.narrowed(F.col(s.use) & (~m if truth(p, "invert", False) else m), "brightestPixels", p.get("mask_statistics"), "brightest", df=df)


@operator("smoothness", params="threshold kernel_size min_object_size mask_statistics")
def smoothness(s: State, p: Params) -> State:
    least = int(number(p, "min_object_size", 100))
    df = neighbourhood.flat(s.df.withColumn("__g", gray()), "__g", int(number(p, "kernel_size", 10)), number(p, "threshold", 0.01), "__flat")
    df = s.kernel("fill_holes")(s.kernel("remove_small")(df, "__flat", least), "__flat", least)
    return s.narrowed(F.col(s.use) & ~F.col("__flat"), "flat_areas", p.get("mask_statistics"), "smoothness", df=df)


def _regions(s: State, mask: str, prefix: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: s.kernel("region_statistics")(df.select("slide_id", "r", "c", mask), mask, 8, prefix).drop(f"{prefix}min_area")


@operator("remove_small", params="min_size mask_statistics")
def remove_small(s: State, p: Params) -> State:
    kept, gone = s.own("kept"), s.own("gone")
    df = s.kernel("remove_small")(s.df, s.use, int(number(p, "min_size", 64)), kept).withColumn(gone, F.col(s.use) & ~F.col(kept))
    return s.narrowed(F.col(kept), "small_tissue_removed_percent", p.get("mask_statistics"), "remove_small", df=df).with_frame(_regions(s, gone, "small_tissue_removed_"))


@operator("remove_large", params="max_size mask_statistics")
def remove_large(s: State, p: Params) -> State:
    return s.narrowed(F.col("__kept"), "large_tissue_removed_percent", p.get("mask_statistics"), "remove_large", df=s.kernel("remove_large")(s.df, s.use, int(number(p, "max_size", 1 << 30)), "__kept"))


@operator("fill_holes", params="min_size mask_statistics")
def fill_holes(s: State, p: Params) -> State:
    filled, new = s.own("filled"), s.own("new")
    df = s.kernel("fill_holes")(s.df, s.use, int(number(p, "min_size", 64)), filled).withColumn(new, F.col(filled) & ~F.col(s.use))
    return s.narrowed(F.col(filled), "small_tissue_filled_percent", p.get("mask_statistics"), "fill_holes", df=df).with_frame(_regions(s, new, "small_tissue_filled_"))


@operator("fat_like", params="fat_cell_size kernel_size max_keep_size mask_statistics")
def fat_like(s: State, p: Params) -> State:
    fat = s.own("fat")
    df = s.kernel("fat_like")(s.df, s.use, int(number(p, "fat_cell_size", 64)), int(number(p, "kernel_size", 3)), int(number(p, "max_keep_size", 1000)), fat)
    return s.narrowed(F.col(s.use) & ~F.col(fat), "fatlike_tissue_removed_percent", p.get("mask_statistics"), "fat_like", df=df).with_frame(_regions(s, fat, "fatlike_tissue_removed_"))


@operator("blur", params="image_work_size blur_radius blur_threshold mask_statistics")
def blur(s: State, p: Params) -> State:
    """What is blurred at a size of its own, brought back to the working size by scaled places; without such pixels, at the working size."""
    size, other = p.get("image_work_size"), s.sized(p.get("image_work_size"))
    if size and other is None:
        s = s.noted(f"No pixels at {size}: blur is found at the working size")
    radius, limit = number(p, "blur_radius", 7), number(p, "blur_threshold", 0.1)
    start = s.df if other is None else neighbourhood.by_slide(other)
    sharp = neighbourhood.laplacian(start.withColumn("__g", gray()), "__g", "__lap").withColumn("__lap", F.abs("__lap"))
    soft = s.kernel("blurred")(sharp, "__lap", radius, "__soft").withColumn("__soft", F.col("__soft") <= limit)
    blurry = s.own("blurry")
    df = (soft if other is None else neighbourhood.resized_by_slide(soft, "__soft", s.df, "__soft")).withColumn(blurry, F.coalesce("__soft", F.lit(False)) & F.col(s.use))
    return s.narrowed(F.col(s.use) & ~F.col(blurry), "blurry_removed_percent", p.get("mask_statistics"), "blur", df=df).with_frame(_regions(s, blurry, "blurry_removed_"))


@operator("spur", params="disk_radius mask_statistics")
def spur(s: State, p: Params) -> State:
    return s.narrowed(F.col("__open"), "spur_pixels", p.get("mask_statistics"), "spur", df=s.kernel("open_disk")(s.df, s.use, int(number(p, "disk_radius", 25)), "__open"))


@operator("area", params="area_threshold mask_statistics")
def area(s: State, p: Params) -> State:
    return s.narrowed(F.col("__big"), "areaThresh", p.get("mask_statistics"), "area", df=s.kernel("remove_small")(s.df, s.use, int(number(p, "area_threshold", 1000)), "__big"))


@operator("pieces")
def pieces(s: State, p: Params) -> State:
    return s.with_frame(lambda df: s.kernel("region_statistics")(df.select("slide_id", "r", "c", s.use), s.use).select("slide_id", F.col("num_regions").alias("#pieces_of_tissue")))


@operator("texture", params="prefix patch_size npatches nlevels feats invert mask_name")
def texture(s: State, p: Params) -> State:
    mask, invert = mask_of(s, p)

    def found(df: DataFrame) -> DataFrame:
        own = df.withColumn("__m", ~F.col(mask) if invert else F.col(mask))
        made = stats.texture(own, stats.sampled_corners(own, "__m", int(number(p, "npatches", 100))), int(number(p, "patch_size", 32)), int(number(p, "nlevels", 8)))
        wanted = [x for x in p.get("feats", "").split(":") if x]
        return made.select("slide_id", *[F.col(c).alias(prefixed(p) + c) for c in made.columns[1:] if not wanted or c.removesuffix("_std") in wanted])

    return s.with_frame(found)


@operator("contrast", params="prefix limit_to_mask invert mask_name")
def contrast(s: State, p: Params) -> State:
    return s.with_frame(lambda df: stats.contrast(df, *mask_of(s, p), prefixed(p)))


@operator("brightness", params="prefix limit_to_mask invert mask_name")
def brightness(s: State, p: Params) -> State:
    return s.with_frame(lambda df: stats.brightness(df, None, *mask_of(s, p), prefixed(p)))


@operator("channel_brightness", params="prefix to_color_space limit_to_mask invert mask_name")
def channel_brightness(s: State, p: Params) -> State:
    return s.with_frame(lambda df: stats.brightness(df, p.get("to_color_space", "RGB"), *mask_of(s, p), prefixed(p)))


@operator("histogram", params="bins limit_to_mask")
def histogram(s: State, p: Params) -> State:
    text = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("channel", "bin", F.round("density", 9).alias("density")))), lambda x: x["density"]))
    return s.with_frame(lambda df: stats.histogram(df, int(number(p, "bins", 20)), mask_of(s, p)[0]).groupBy("slide_id").agg(text.alias("histogram")))


@operator("template_distance", params="bins limit_to_mask")
def template_distance(s: State, p: Params) -> State:
    if s.templates is None:
        return s
    found = lambda df: stats.template_distance(stats.histogram(df, int(number(p, "bins", 20)), mask_of(s, p)[0]), s.templates)
    names = sorted(r[0] for r in s.templates.select("template").distinct().collect())
    return s.with_frame(lambda df: found(df).groupBy("slide_id").pivot("template", names).agg(F.first("distance")).select("slide_id", *[F.col(n).alias(f"{n}_MSE_hist") for n in names]))


@operator("stains", params="stain use_mask")
def stains(s: State, p: Params) -> State:
    return s.with_frame(lambda df: stats.stains(df, p.get("stain", "hed_from_rgb").removesuffix("_from_rgb"), s.use if truth(p, "use_mask", True) else None))


@operator("final", params="mask_statistics")
def final(s: State, p: Params) -> State:
    mode = p.get("mask_statistics", "absolute")
    return replace(s, counted=(*s.counted, ("pixels_to_use", s.use, s.use, "absolute" if mode == "relative2mask" else mode)))


@operator("keep", params="use_mask")
def keep(s: State, p: Params) -> State:
    """The final mask as a column and as a picture, and (use_mask) the slide's luminance as green with the mask as red and blue."""
    made = replace(s, df=s.df.withColumn("final", masks.forced_out(F.col(s.use), *[F.col(m) for m in s.forced])))
    made = made.with_output("mask_use", lambda df: raster.pictures(df, ["final"]))
    if not truth(p, "use_mask", True):
        return made
    return made.with_output("fuse", lambda df: raster.pictures(masks.overlaid(df, "final"), ["over_red", "over_green", "over_blue"]))


@operator("keep_named", params="suffix")
def keep_named(s: State, p: Params) -> State:
    """The present mask under a name, as a column (``mask_`` and the name) and as a picture."""
    name = p.get("suffix")
    if not name:
        return s.noted("Please set the suffix for mask use.")
    return replace(s, df=s.df.withColumn(f"mask_{name}", F.col(s.use))).with_output(name, lambda df: raster.pictures(df, [f"mask_{name}"]))


@operator("equalise")
def equalise(s: State, p: Params) -> State:
    return replace(s, df=masks.equalised(s.df))


@operator("classify_bayes", params="name threshold tsv_file mask_statistics")
def classify_bayes(s: State, p: Params) -> State:
    """Takes off pixels that a Gaussian naive Bayes, fitted to the given training colours, puts in the second class."""
    name = p.get("name", "classTask")
    if "tsv_file" in p and s.given.keys().isdisjoint({"training", f"training:{name}"}):
        s = replace(s, given={**s.given, f"training:{name}": tables.training_colours(s.df.sparkSession, p["tsv_file"])})
    training = given(s, "training", name)
    m = learning.gaussian_bayes(training, ["red", "green", "blue"]) > number(p, "threshold", 0.5)
    return s.narrowed(F.col(s.use) & ~m, name, p.get("mask_statistics"), "classify_bayes")


def given(s: State, kind: str, name: str | None) -> DataFrame:
    """A table that the caller hands over, for this step by name or for all steps of its kind."""
    found = s.given.get(f"{kind}:{name}", s.given.get(kind))
    if found is None:
        raise ValueError(f"the step {name or ''} needs a table: {kind}")
    return found


def features_of(p: Params) -> dict[str, Callable]:
    """The registered features with the parameters that a step gives them."""
    numbers = lambda key, default: tuple(float(x) for x in p.get(key, default).strip("() ").split(",") if x.strip())
    low, high = numbers("frangi_scale_range", "(1, 10)")
    return raster.features_with(
        laplace_size=int(number(p, "laplace_ksize", 3)),
        scales=tuple(np.arange(low, high, number(p, "frangi_scale_step", 2))),
        beta=number(p, "frangi_beta1", 0.5),
        gamma=number(p, "frangi_beta2", 15),
        dark_ridges=truth(p, "frangi_black_ridges", True),
        thetas=int(number(p, "gabor_theta", 4)),
        sigmas=numbers("gabor_sigma", "(1,3)"),
        frequencies=numbers("gabor_frequency", "(0.05, 0.25)"),
        lbp_points=int(number(p, "lbp_points", 24)),
        lbp_radius=number(p, "lbp_radius", 3),
        lbp_method=p.get("lbp_method", "default"),
        median_radius=int(number(p, "median_disk_size", 3)),
        gaussian_sigma=number(p, "gaussian_sigma", 1),
    )


def with_features(df: DataFrame, names: list[str], params: Params | None = None) -> tuple[DataFrame, list[str]]:
    """Pixels with the named features, and the columns that they make."""
    known = features_of(params or {})
    if "gaussian" in names and truth(params or {}, "gaussian_multichan", False):
        sigma = number(params, "gaussian_sigma", 1)
        for channel in ("red", "green", "blue"):
            df = raster.blurred(df, channel, sigma, f"gaussian_{channel}")
        rest, columns = with_features(df, [n for n in names if n != "gaussian"], params)
        return rest, [*columns, "gaussian_red", "gaussian_green", "gaussian_blue"]
    columns = [c for n in names for c in (["red", "green", "blue"] if n == "rgb" else [k for k in known if k == n or k.startswith(f"{n}_")])]
    unknown = [n for n in names if n != "rgb" and not any(k == n or k.startswith(f"{n}_") for k in known)]
    if unknown:
        raise NameError(f"no such feature: {', '.join(unknown)}")
    wanted = {c: known[c] for c in columns if c in known}
    return (raster.features(df.withColumn("__g", gray()), "__g", wanted) if wanted else df), columns


@operator("classify_examples", params="name threshold examples features nsamples_per_example area_threshold dilate_kernel_size laplace_ksize frangi_scale_range frangi_scale_step frangi_beta1 frangi_beta2 frangi_black_ridges gabor_theta gabor_sigma gabor_frequency lbp_radius lbp_points lbp_method median_disk_size gaussian_sigma gaussian_multichan mask_statistics")
def classify_examples(s: State, p: Params) -> State:
    """Takes off what a forest, fitted to given example pixels with labels, marks; the mark is forced off at the end too."""
    name = p.get("name", "classTask")
    names = [x.split("#")[0].strip() for x in p.get("features", "rgb").split("\n")]
    examples, columns = with_features(given(s, "examples", name), [x for x in names if x], p)
    model = learning.forest(learning.sampled(examples, number(p, "nsamples_per_example", -1)), columns)
    marked, mark = with_features(s.df, [x for x in names if x], p)[0], s.own("mark")
    marked = learning.probability(model, marked, columns, "__p").withColumn(mark, F.col("__p") > number(p, "threshold", 0.5))
    marked = raster.remove_small(marked.drop("__p", "__g", *[c for c in columns if c not in s.df.columns]), mark, int(number(p, "area_threshold", 5)))
    if side := int(number(p, "dilate_kernel_size", 0)):
        marked = neighbourhood.dilate_square(marked, mark, side, mark)
    marked = marked.withColumn(mark, F.col(mark) & F.col(s.use))
    made = s.narrowed(F.col(s.use) & ~F.col(mark), name, p.get("mask_statistics"), "classify_examples", df=marked)
    return replace(made, forced=(*made.forced, mark))


@operator("annotation", params="format file_path suffix mask_statistics")
def annotation(s: State, p: Params) -> State:
    """Keeps what lies in the given regions of each slide; slides without regions are left whole, with a warning's metric of 0."""
    if "regions" not in s.given and p.get("file_path"):
        found = annotations.regions_by_slide(s.df.sparkSession, p["file_path"], p.get("format", "xml"), p.get("suffix", ""))
        if found is None:
            return s.noted(f"unsupported file format '{p.get('format')}'. Skipping...")
        s = replace(s, given={**s.given, "regions": found.withColumn("slide_id", F.col("slide_id").cast(s.df.schema["slide_id"].dataType))})
    regions = annotations.repaired(annotations.valid(given(s, "regions", None)))
    crossed = regions.groupBy("slide_id").agg(F.max("repaired").alias("on"))
    s = replace(s, warned=(*s.warned, ("Annotation has regions that are no simple polygons; they were taken apart", lambda df: crossed)))
    mask, there = s.own("annotated"), s.own("there")
    known = regions.select("slide_id", F.lit(True).alias(there)).distinct()
    df = annotations.annotation_mask(s.df, regions, mask, s.scale).join(known, "slide_id", "left")
    return s.narrowed(F.col(s.use) & (F.col(mask) | F.col(there).isNull()), "getAnnotationMask", p.get("mask_statistics"), "annotation", df=df)


@operator("roi_scan", params="name level win_size area_threshold")
def roi_scan(s: State, p: Params) -> State:
    """The share of dark ridges of a level, found window by window; it touches no mask.

    The level's pixels are those given for the size "level <number>"; without them the working size is scanned, with a warning.
    """
    level, name = p.get("level", "1"), p.get("name", "classTask")
    other = s.sized(f"level {level}")
    if other is None:
        s = s.noted(f"No pixels of level {level}: ridges are found at the working size")
    least = int(number(p, "area_threshold", 0))
    return s.with_frame(lambda df: raster.ridge_share(df if other is None else other, int(number(p, "win_size", 2048)), least, name))


@operator("tiles", params="tile_size tile_stride tissue_ratio scale screen screen_limit save")
def extract(s: State, p: Params) -> State:
    """The windows of accepted tiles as JSON; scale: slide pixels to a mask pixel.

    ``screen`` names a predicate on the tiles' pixels, and ``save`` asks for their pictures: both read the slide's own
    pixels, those given for the size "slide".
    """
    scale, screen = number(p, "scale", s.scale), p.get("screen")
    own = s.sized("slide")
    if own is None and (screen or truth(p, "save", False)):
        s = s.noted("No pixels of the whole slide: tiles are neither screened nor saved")
    size = (int(number(p, "tile_size", 256)), int(number(p, "tile_stride", 256)))

    def found(df: DataFrame) -> DataFrame:
        windows = tiles.extract_tiles(df, s.use, int(scale * 1_000_000), 1_000_000, *size, number(p, "tissue_ratio", 0.5))
        return windows if own is None or not screen else tiles.screened(windows, own, tiles.SCREENS[screen](number(p, "screen_limit", None)))

    if own is not None and truth(p, "save", False):
        s = s.with_output("tiles", lambda df: tiles.pictures(found(df), own))
    return s.with_frame(lambda df: tiles.as_json(found(df)))


@operator("macro", params="small_dim")
def macro(s: State, p: Params) -> State:
    """The slides' overview pictures, a given table of pixels "macro", no side longer than ``small_dim``; without it a warning."""
    if "macro" not in s.given:
        return s.noted("Can't Read 'macro' Image from Slide's Associated Images")
    return s.with_output("macro", lambda df: raster.pictures(within(s.given["macro"], int(number(p, "small_dim", 500))), ["red", "green", "blue"]))


def within(df: DataFrame, longest: int) -> DataFrame:
    """Pixels of each slide, of which squares are averaged so that no side is longer."""
    sides = df.groupBy("slide_id").agg(F.ceil((F.greatest(F.max("r"), F.max("c")) + 1) / longest).cast("int").alias("__by"))
    means = [F.bround(F.avg(n)).cast("int").alias(n) for n in ("red", "green", "blue")]
    return df.join(sides, "slide_id").groupBy("slide_id", F.expr("cast(r div __by as int)").alias("r"), F.expr("cast(c div __by as int)").alias("c")).agg(*means)


@operator("thumbnails", params="small_dim image_work_size")
def thumbnails(s: State, p: Params) -> State:
    """The slide at a size (the working size, if no pixels are given for another), and small: no side longer than ``small_dim``."""
    colours, other = ["red", "green", "blue"], s.sized(p.get("image_work_size"))
    small = int(number(p, "small_dim", 500))
    return s.with_output("thumb", lambda df: raster.pictures(df if other is None else other, colours)).with_output("thumb_small", lambda df: raster.pictures(within(df, small), colours))


@operator("geojson", params="suffix mask_name")
def geojson(s: State, p: Params) -> State:
    """A mask's outlines in slide pixels, under the name of the suffix; a slide whose mask is empty gets a warning."""
    if not p.get("suffix"):
        return s.noted("Please set the suffix for mask use in geojson.")
    name = p.get("mask_name", "img_mask_use")
    mask = s.use if name == "img_mask_use" else name.removeprefix("img_mask_")
    mask = f"mask_{mask}" if f"mask_{mask}" in s.df.columns else mask
    if mask not in s.df.columns:
        return s.noted(f"The `{name}` mask dosen't exist. Please use correct mask name.")
    empty = "No contour detected at use mask image. Geojson annotation won't be generated."
    warned = replace(s, warned=(*s.warned, (empty, lambda df: df.groupBy("slide_id").agg((F.count_if(mask) == 0).alias("on")))))
    return warned.with_output(p["suffix"], lambda df: raster.contours(df, mask, s.scale))


#: Step names of configuration files and the operators that they mean (fixed values).
STEP_NAMES = {
    "BasicModule.getBasicStats": "basic_stats",
    "LightDarkModule.getIntensityThresholdPercent": "intensity",
    "LightDarkModule.getIntensityThresholdOtsu": "otsu",
    "LightDarkModule.minimumPixelIntensityNeighborhoodFiltering": "minimum_neighbourhood",
    "LightDarkModule.removeBrightestPixels": "brightest",
    "BubbleRegionByRegion.detectSmoothness": "smoothness",
    "MorphologyModule.removeSmallObjects": "remove_small",
    "MorphologyModule.removeLargeObjects": "remove_large",
    "MorphologyModule.fillSmallHoles": "fill_holes",
    "MorphologyModule.removeFatlikeTissue": "fat_like",
    "BlurDetectionModule.identifyBlurryRegions": "blur",
    "BasicModule.finalProcessingSpur": "spur",
    "BasicModule.finalProcessingArea": "area",
    "BasicModule.countTissuePieces": "pieces",
    "LocalTextureEstimationModule.estimateGreyComatrixFeatures": "texture",
    "BrightContrastModule.getContrast": "contrast",
    "BrightContrastModule.getBrightnessGray": "brightness",
    "BrightContrastModule.getBrightnessByChannelinColorSpace": "channel_brightness",
    "HistogramModule.getHistogram": "histogram",
    "HistogramModule.compareToTemplates": "template_distance",
    "DeconvolutionModule.separateStains": "stains",
    "BasicModule.finalComputations": "final",
    "SaveModule.saveFinalMask": "keep",
    "SaveModule.saveMask": "keep_named",
    "LightDarkModule.saveEqualisedImage": "equalise",
    "ClassificationModule.pixelWise": "classify_bayes",
    "ClassificationModule.byExampleWithFeatures": "classify_examples",
    "AnnotationModule.saveAnnotationMask": "annotation",
    "BubbleRegionByRegion.roiWise": "roi_scan",
    "TileExtractionModule.extract": "tiles",
    "SaveModule.saveMacro": "macro",
    "SaveModule.saveThumbnails": "thumbnails",
    "SaveModule.saveMask2Geojson": "geojson",
}
OPERATORS |= {name: OPERATORS[own] for name, own in STEP_NAMES.items()}


# --- binding and running -------------------------------------------------------------------------------


def parsed(text: str) -> tuple[list[Step], str]:
    """Steps and the statistic of an INI text; lines that start with # or ; are off."""
    ini = configparser.ConfigParser(strict=False, comment_prefixes=("#", ";"), interpolation=None)
    ini.optionxform = str
    ini.read_string(text)
    steps = []
    for line in ini.get("pipeline", "steps").split("\n"):
        if line := line.strip():
            name, _, label = line.partition(":")
            if name.count(".") > 1 or "." in label:
                raise ValueError(f"not a step: {line}")
            steps.append(Step(name, label or None, dict(ini.items(line)) if ini.has_section(line) else {}))
    return steps, ini.get("BaseImage.BaseImage", "mask_statistics", fallback="relative2mask")


def bound(steps: list[Step]) -> tuple[list[tuple[Operator, Step]], list[str]]:
    """Operators of the steps and warnings of parameters that none reads; unknown steps raise NameError."""
    unknown = [s.name for s in steps if s.name not in OPERATORS]
    if unknown:
        raise NameError(f"no such step: {', '.join(unknown)}")
    warnings = [f"{s.name}{':' + s.label if s.label else ''} does not read {k}" for s in steps for k in s.params if k not in OPERATORS[s.name].params]
    return [(OPERATORS[s.name], s) for s in steps], warnings


def needed(steps: list[Step], metrics: set[str] | None) -> list[Step]:
    """Without the steps that only add metrics nobody asked for; steps that make masks stay."""
    only = {"texture": ("contrast", "homogeneity", "energy", "ASM", "correlation", "dissimilarity"), "contrast": ("_contrast",), "brightness": ("grayscale_brightness",), "channel_brightness": ("chan",), "histogram": ("histogram",), "template_distance": ("_MSE_hist",), "stains": ("deconv_",), "pieces": ("#pieces",)}
    if metrics is None:
        return steps
    asked = lambda s: any(part in m for m in metrics for part in only[OPERATORS[s.name].name])
    return [s for s in steps if OPERATORS[s.name].name not in only or asked(s)]


def folded(pixels: DataFrame, steps: list[Step], mode: str = "relative2mask", slides: DataFrame | None = None, templates: DataFrame | None = None, given: dict[str, DataFrame] | None = None, sizes: dict[str, DataFrame] | None = None, scale: float = 1.0, block: int | None = None) -> State:
    """The state after all steps; nothing has run yet but what templates or classifiers need.

    given: tables of steps that need them, "training", "examples" or "regions", or these with a colon and a step's name.
    sizes: pixels at other working sizes by the text that steps ask for ("2.5x", "level 1", "slide"). scale: slide pixels to a
    pixel. block: slides may be too large for a task, and steps that have kernels over blocks of so many pixels a side use them.
    """
    start = neighbourhood.by_slide(pixels).withColumns({"use_0": F.lit(True), "__failed": F.lit(None).cast("string")})
    state = State(start, mode=mode, slides=slides, templates=templates, given=given or {}, sizes=sizes or {}, scale=scale, block=block)
    for op, step in bound(steps)[0]:
        state = op.run(state, step.params)
        state = replace(state, done=(*state.done, step.name))
    return state


def metrics(state: State) -> DataFrame:
    """One row a slide: mask statistics of all steps from one aggregate, the other metrics, completed and warnings.

    A slide that a step's kernel failed on has the status "failed", the error, and no metrics; others are not touched.
    """
    names = sorted({c for _, a, b, _ in state.counted for c in (a, b)} | {c for _, c in state.guarded}, key=lambda c: int(c.split("_")[1]))
    df = stored(state.df.select(*[c for c in state.df.columns if c not in ("__g", "__lap", "__soft", "__g8", "__min")])) if len(state.frames) > 1 else state.df
    counts = df.groupBy("slide_id").agg(F.count(F.lit(1)).alias("__total"), F.max("__failed").alias("error"), *[F.count_if(c).alias(c) for c in names])
    chosen = {m: masks.statistic(mode, F.col(a), F.col(b), F.col("__total")) for m, a, b, mode in state.counted}  # of a name that repeats, the last
    empty = F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(f"After {w} NO tissue remains detectable")) for w, c in state.guarded]), lambda x: x.isNotNull()) if state.guarded else F.array().cast("array<string>")
    empty = F.concat(F.array(*map(F.lit, state.notes)), empty) if state.notes else empty
    status = F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status")
    row = counts.select("slide_id", *[c.alias(m) for m, c in chosen.items()], empty.alias("warnings"), F.array(*map(F.lit, state.done)).alias("completed"), status, "error")
    for frame in state.frames:
        more = frame(df)
        row = row.drop(*more.columns[1:]).join(more, "slide_id", "left")  # here, too, the last of a name that repeats
    kept = ("slide_id", "warnings", "completed", "status", "error")
    for text, found in state.warned:
        on = found(df).select("slide_id", F.col("on").alias("__on"))
        row = row.join(on, "slide_id", "left").withColumn("warnings", F.when(F.col("__on"), F.concat("warnings", F.array(F.lit(text)))).otherwise(F.col("warnings"))).drop("__on")
    return row.select(*[F.col(f"`{c}`") if c in kept else F.when(F.col("error").isNull(), F.col(f"`{c}`")).alias(c) for c in row.columns])


def outputs(state: State) -> dict[str, DataFrame]:
    """What the steps of a pipeline save besides metrics, by name: slide_id and png (pictures) or geojson."""
    return {name: output(state.df) for name, output in state.outputs}


def header(text: str, started: str, outdir: str, config: str | None = None, arguments: str = "") -> list[str]:
    """The lines before a metric table: what ran, when, on what and with what arguments (names are fixed)."""
    steps = " ".join(s.name + (f":{s.label}" if s.label else "") for s in parsed(text)[0])
    given_ = {"start_time": started, "pipeline": steps, "outdir": outdir, "config_file": config or "default", "command_line_args": arguments}
    return [f"#{k}:\t{v}" for k, v in given_.items()]


def run(pixels: DataFrame, text: str, **more) -> DataFrame:
    steps, mode = parsed(text)
    return metrics(folded(pixels, steps, mode, **more))


def isolated(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """A grouped map by slide that turns a slide's failure into a row: slide_id, status, error and the schema's columns."""
    import pandas as pd

    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def guarded(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["slide_id"].iloc[0]
        try:
            return pd.DataFrame([{"slide_id": key, "status": "done", "error": None, **work(pdf)}])
        except Exception as e:  # the slide's own failure is its result
            return pd.DataFrame([{"slide_id": key, "status": "failed", "error": f"{type(e).__name__}: {e}", **dict.fromkeys(names)}])

    return df.groupBy("slide_id").applyInPandas(guarded, f"slide_id long, status string, error string, {schema}")
