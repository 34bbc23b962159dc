"""Session and table helpers shared by the slide queries."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "glasspane", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries assume (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, with its full schema; Catalyst prunes the columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local masters without a shared one, by application.
_TEMPORARY: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, with its scheme: spark.checkpoint.dir, or on a local master without one a temporary folder."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        folder = _TEMPORARY.get(context.applicationId) or _TEMPORARY.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='glasspane-')}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the folder that all executors share, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Adds each row's place (from 1) in a total order (columns, ascending or with a direction), without one task for all rows.

    Rows are dealt by range and numbered within their range; the counts of the ranges before are added. The dealt
    rows are stored first, since two reads of a range partitioning need not agree.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).selectExpr("__part", "sum(__n) over (order by __part) - __n as __before")  # a row a partition
    inner = dealt.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return inner.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__row")).cast("long")).drop("__part", "__row", "__before")
