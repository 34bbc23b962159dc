"""What several operators of this package share: reading tables, cutting lineage, cleaning up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local masters without a shared one, by application.
_TEMPORARY: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor shares, as the cluster names it, with its scheme; a temporary one on a local master without a name."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        folder = _TEMPORARY.get(context.applicationId) or _TEMPORARY.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='glasspane-')}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


class Shelf:
    """Tables written to the shared folder in the course of one query.

    put() writes a frame and reads it back, so lineage ends there and a lost executor costs no
    recomputation; drop() deletes what is no longer needed.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{owner}-{uuid.uuid4().hex}"
        self.count = 0
        self.names: dict[int, str] = {}

    def put(self, frame: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        frame.write.parquet(path)
        table = self.spark.read.schema(frame.schema).parquet(path)
        self.names[id(table)] = f"{self.count}-{name}"
        return table

    def drop(self, frame_or_none: DataFrame | None = None) -> None:
        path = self.root if frame_or_none is None else frame_or_none.inputFiles()[0].rsplit("/", 1)[0] if frame_or_none.inputFiles() else None
        if path:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def drop_others(self, *kept: DataFrame) -> None:
        """Deletes all tables of this shelf but these, which must be tables as put() gave them."""
        names = {self.names[id(frame)] for frame in kept}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(root):
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)


#: A key with over one in HOT_KEYS of the rows is hot; there are at most so many.
HOT_KEYS = 2000


def hot_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined to table, which has each key once and in ``weight`` the key's share of the ``total`` rows.

    Hot keys (HOT_KEYS at most, so their part of the table is small) are broadcast and their rows stay where
    they are; all other rows are dealt by key, and no key is more than one task's. table should be a stored one.
    """
    hot = table.where(F.col(weight) * HOT_KEYS > total)
    if hot.isEmpty():
        return rows.join(table, key)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(weight) * HOT_KEYS <= total), key)
    return near.unionByName(far)


def crc_fold(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as themselves, the others as signs from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Rows of texts that go to Python at once.
BATCH_ROWS = 400


def in_batches(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow in small batches: texts may be long, and a worker holds a batch several times over.

    The batch size is a setting of the session; one that the user chose stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = rows.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))

    def tidy(batches):
        yield from run(batches)
        give_back()

    return rows.mapInArrow(tidy, schema)


def give_back() -> None:
    """Frees what a task held: workers live on, and their free memory counts against the executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
