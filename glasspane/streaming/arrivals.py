"""Incremental arrival, an extension: new files run through the same batch logic, once each.

The checkpoint is the set of what is done, so a rerun skips it; state is keyed and bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.batches import Ledger


def arrivals(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of new parquet files under a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)


def daily(events: DataFrame, at: str = "ts", late: str = "2 days") -> DataFrame:
    """day, event_type, n, total per day of event time; rows later than the watermark are left out."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def processed(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs the batch logic on all that has arrived, writes each batch under its own number, and stops.

    A batch that is run again after a failure overwrites its own folder, so results come once.
    """

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def processed_slides(stream: DataFrame, work: Callable[[DataFrame], DataFrame], ledger: Ledger, checkpoint: str, force: bool = False) -> StreamingQuery:
    """The same through a ledger of finished slides: those it has are passed over, or replaced with force."""

    def each(batch: DataFrame, number: int) -> None:
        ledger.add(work, batch, force, key=f"stream-{number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
