"""Image pyramids in tiles: a data source over DeepZoom folders, of which a query reads only the tiles that it needs.

A slide is ``<folder>/<slide>.dzi``, its size, and ``<folder>/<slide>_files/<number>/<column>_<row>.png``. Level 0 is
the whole slide, each further one half of the one before, as slide readers count them.

Filters on slide_id and level, and bounds on r and c, are pushed down: the source lists slides by their descriptors
and works out by arithmetic which tiles a level and a box touch; no tile besides is opened. A task takes up
to ``tilesPerTask`` tiles of one slide and holds one of them at a time.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import kernels
from .pixels import decimated
from .slides import nearest_level

FORMAT = "glasspane_pyramid"
SCHEMA = "slide_id string, level int, tile_r int, tile_c int, r int, c int, red int, green int, blue int"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(folder: str):
    """(file system, path) of a folder's URI or plain path; s3a is s3 to pyarrow."""
    import pyarrow.fs

    if "://" not in folder and not folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), folder.rstrip("/")
    fs, path = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3a://", "s3://", folder)))
    return fs, path.rstrip("/")


def put(fs, path: str, data: bytes) -> None:
    """A file under its name only once it is whole, so that a task may be repeated or run twice."""
    new = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as out:
        out.write(data)
    fs.move(new, path)


def halved(side: int, level: int) -> int:
    """A side's pixels at a level: each halving keeps a last odd pixel."""
    return (side + (1 << level) - 1) >> level


@dataclass(frozen=True)
class Slide:
    name: str
    width: int
    height: int
    tile: int
    overlap: int
    kind: str

    @property
    def top(self) -> int:
        """The number of the folder that has level 0."""
        return max(0, (max(self.width, self.height) - 1).bit_length())

    def path(self, level: int, tile_r: int, tile_c: int) -> str:
        return f"{self.name}_files/{self.top - level}/{tile_c}_{tile_r}.{self.kind}"


def described(name: str, text: str) -> Slide:
    found = lambda key, default=None: m[1] if (m := re.search(rf'\b{key}="([^"]*)"', text)) else default
    return Slide(name, int(found("Width")), int(found("Height")), int(found("TileSize")), int(found("Overlap", "0")), found("Format", "png"))


def descriptor(width: int, height: int, tile: int) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<Image xmlns="http://schemas.microsoft.com/deepzoom/2008" Format="png" Overlap="0" TileSize="{tile}"><Size Width="{width}" Height="{height}"/></Image>\n'


@dataclass
class Tiles(InputPartition):
    slide: Slide
    level: int
    places: list


class PyramidReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.per_task = options["path"], int(options.get("tilespertask", 16))
        self.slides, self.levels = None, None
        self.low, self.high = {"r": 0, "c": 0}, {"r": 1 << 31, "c": 1 << 31}

    def pushFilters(self, filters):
        """Takes what tells tiles apart; Spark applies all filters again to the rows."""
        for f in filters:
            (name, *more), is_set = f.attribute, isinstance(f, (EqualTo, In))
            if name in ("slide_id", "level") and not more and is_set:
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                key = "slides" if name == "slide_id" else "levels"
                setattr(self, key, own if getattr(self, key) is None else getattr(self, key) & own)
            elif name in self.low:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], f.value - isinstance(f, LessThan))
            yield f

    def partitions(self):
        import pyarrow.fs

        fs, folder = opened(self.folder)
        if self.slides is None:
            names = [x.base_name[:-4] for x in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if x.base_name.endswith(".dzi")]
        else:
            names = [n for n in self.slides if fs.get_file_info(f"{folder}/{n}.dzi").type == pyarrow.fs.FileType.File]
        parts = []
        for name in sorted(names):
            with fs.open_input_stream(f"{folder}/{name}.dzi") as f:
                slide = described(name, f.read().decode())
            stored = [int(x.base_name) for x in fs.get_file_info(pyarrow.fs.FileSelector(f"{folder}/{name}_files")) if x.base_name.isdigit()]
            for level in sorted(slide.top - k for k in stored):
                if self.levels is None or level in self.levels:
                    rows, columns = (range(max(0, self.low[k]) // slide.tile, min(self.high[k], halved(side, level) - 1) // slide.tile + 1) for k, side in (("r", slide.height), ("c", slide.width)))
                    places = [(r, c) for r in rows for c in columns]
                    parts += [Tiles(slide, level, places[k : k + self.per_task]) for k in range(0, len(places), self.per_task)]
        return parts or [Tiles(Slide("", 1, 1, 1, 0, "png"), 0, [])]

    def read(self, part: Tiles):
        fs, folder = opened(self.folder)
        for tile_r, tile_c in part.places:
            path = f"{folder}/{part.slide.path(part.level, tile_r, tile_c)}"
            with fs.open_input_stream(path) as f:
                try:
                    pixels = kernels.unpng(f.read())
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from None
            top, left = (part.slide.overlap if k else 0 for k in (tile_r, tile_c))  # what neighbours have as well
            pixels = pixels[top : top + part.slide.tile, left : left + part.slide.tile]
            h, w, n = pixels.shape
            r, c = (x.ravel() for x in np.mgrid[0:h, 0:w].astype(np.int32))
            r, c = r + tile_r * part.slide.tile, c + tile_c * part.slide.tile
            inside = (r >= self.low["r"]) & (r <= self.high["r"]) & (c >= self.low["c"]) & (c <= self.high["c"])
            colours = [pixels[:, :, k if n > 2 else 0].ravel()[inside].astype(np.int32) for k in range(3)]
            same = lambda x: np.full(int(inside.sum()), x, np.int32)
            columns = [pa.array([part.slide.name] * int(inside.sum()), pa.string()), *map(pa.array, (same(part.level), same(tile_r), same(tile_c), r[inside], c[inside], *colours))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


class Pyramids(DataSource):
    """The data source: options path and tilesPerTask."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PyramidReader:
        return PyramidReader(self.options)


def read(spark: SparkSession, folder: str, tiles_per_task: int = 16) -> DataFrame:
    """Pixels of all levels of a folder's slides; filters on slide_id, level, r and c choose the tiles.

    Pushdown to sources written in Python is a setting of the session, which this turns on.
    """
    spark.dataSource.register(Pyramids)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format(FORMAT).option("tilesPerTask", tiles_per_task).load(folder)


def region(spark: SparkSession, folder: str, level: int, left: int, top: int, width: int, height: int, **more) -> DataFrame:
    """The pixels of a box of one level, in that level's coordinates."""
    box = F.col("r").between(top, top + height - 1) & F.col("c").between(left, left + width - 1)
    return read(spark, folder, **more).where((F.col("level") == level) & box)


def best_level(spark: SparkSession, factor: float, levels: int) -> int:
    """The level from which a thumbnail of 1 / factor is made: one within 1 % of it, else the coarsest that is fine enough."""
    return spark.range(1).select(nearest_level(F.lit(float(factor)), F.array(*[F.lit(float(1 << k)) for k in range(levels)]))["level"]).first()[0]


def thumbnail(spark: SparkSession, folder: str, factor: int, levels: int, **more) -> DataFrame:
    """slide_id, r, c and colours at 1 / factor, made of the best level tile by tile; no other level is read."""
    level = best_level(spark, factor, levels)
    chosen = read(spark, folder, **more).where(F.col("level") == level).select("slide_id", "r", "c", "red", "green", "blue")
    rest = factor >> level
    return chosen if rest == 1 else decimated(chosen, rest)


def write(pixels: DataFrame, folder: str, tile: int = 256, levels: int | None = None) -> None:
    """A pyramid of each slide's pixels (slide_id, r, c and colours from 0 on; gaps are black), a task a tile.

    Each level is made of the one before. Without ``levels``, until the largest slide fits in one tile. Descriptors are written last.
    """
    colours = ["red", "green", "blue"]
    sizes = pixels.groupBy(F.col("slide_id").cast("string").alias("slide_id")).agg((F.max("c") + 1).cast("int").alias("width"), (F.max("r") + 1).cast("int").alias("height"))
    longest = sizes.agg(F.max(F.greatest("width", "height"))).first()[0] or 1
    levels = levels or max(1, (-(-longest // tile) - 1).bit_length() + 1)
    now = pixels.select(F.col("slide_id").cast("string").alias("slide_id"), "r", "c", *colours)

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        slide = Slide(first["slide_id"], int(first["width"]), int(first["height"]), tile, 0, "png")
        level, tile_r, tile_c = (int(first[k]) for k in ("level", "tile_r", "tile_c"))
        h, w = (min(tile, halved(side, level) - k * tile) for side, k in ((slide.height, tile_r), (slide.width, tile_c)))
        layers = np.zeros((h, w, 3), np.uint8)
        layers[pdf["r"] - tile_r * tile, pdf["c"] - tile_c * tile] = pdf[colours].to_numpy()
        fs, at = opened(folder)
        path = f"{at}/{slide.path(level, tile_r, tile_c)}"
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        put(fs, path, kernels.png(layers))
        return pd.DataFrame({"n": [1]})

    def describe(batches):
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        for pdf in batches:
            for name, width, height in zip(pdf["slide_id"], pdf["width"], pdf["height"]):
                put(fs, f"{at}/{name}.dzi", descriptor(width, height, tile).encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    for level in range(levels):
        if level:
            now = decimated(now, 2)
        placed = now.join(sizes, "slide_id").withColumns({"level": F.lit(level), "tile_r": F.expr(f"r div {tile}"), "tile_c": F.expr(f"c div {tile}")})
        placed.groupBy("slide_id", "tile_r", "tile_c").applyInPandas(save, "n int").agg(F.sum("n")).collect()
    sizes.mapInPandas(describe, "n int").agg(F.sum("n")).collect()
