"""Pipelines in batches of slides that can be stopped and run again.

A ledger is a folder of batches, each a folder of its own with the metric rows of its slides. A batch counts once it is whole
(Spark's _SUCCESS marks it); what a stopped run leaves of one is overwritten by the next. A slide with a row in
the ledger is finished, failed ones included, and is passed over unless ``force`` asks for it; then its row in the latest
batch is the one that counts. Slides and rows are compared by Spark; the driver knows batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import batched
from . import pipeline

Work = Callable[[DataFrame], DataFrame]


class Ledger:
    """Batches of metric rows under a folder; pass the same folder again to go on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _child(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def batches(self) -> list[str]:
        """The names of whole batches, in order."""
        if not self.files.exists(self.path):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self.path) if x.isDirectory()]
        return sorted(n for n in names if self.files.exists(self._child(n, "_SUCCESS")))

    def rows(self) -> DataFrame | None:
        """All rows of whole batches with their batch; null while there is none."""
        names = self.batches()
        if not names:
            return None
        # of pipelines that differ, batches may have different columns
        return self.spark.read.option("mergeSchema", "true").option("basePath", self.folder).parquet(*[f"{self.folder}/{n}" for n in names])

    def results(self) -> DataFrame | None:
        """One row for each slide: that of the latest batch that has it."""
        rows = self.rows()
        if rows is None:
            return None
        latest = rows.groupBy("slide_id").agg(F.max("batch").alias("batch"))
        return rows.join(latest, ["slide_id", "batch"]).drop("batch")

    def left(self, slides: DataFrame, force: bool = False) -> DataFrame:
        """The slides that have no row yet; with force, all."""
        rows = self.rows()
        return slides if force or rows is None else slides.join(rows.select("slide_id").distinct(), "slide_id", "left_anti")

    def next(self) -> str:
        names = self.batches()
        return f"batch={int(names[-1].split('=')[1].split('-')[0]) + 1 if names else 0:08d}"

    def add(self, work: Work, pixels: DataFrame, force: bool = False, key: str = "") -> str | None:
        """Runs the slides that are left as the next batch and returns its name; with a key, a batch of that key is not run twice."""
        if key and any(n.endswith(f"-{key}") for n in self.batches()):
            return None
        todo = pixels.join(self.left(pixels.select("slide_id").distinct(), force), "slide_id", "left_semi")
        if todo.isEmpty():
            return None
        name = self.next() + (f"-{key}" if key else "")
        work(todo).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return name


def run(pixels: DataFrame, text: str, folder: str, size: int = 100, force: bool = False, **more) -> DataFrame:
    """The metric rows of all slides, made ``size`` slides at a time; slides that the folder's ledger has are not run again."""
    steps, mode = pipeline.parsed(text)
    pipeline.bound(steps)
    ledger = Ledger(pixels.sparkSession, folder)
    left = ledger.left(pixels.select("slide_id").distinct(), force)
    planned = stored(batched(left, "slide_id", size))
    work = lambda df: pipeline.metrics(pipeline.folded(df, steps, mode, **more))
    for number in range((planned.agg(F.max("batch")).first()[0] if not planned.isEmpty() else -1) + 1):
        own = planned.where(F.col("batch") == number).select("slide_id")
        ledger.add(work, pixels.join(own, "slide_id", "left_semi"), force)
    return ledger.results()
