"""A corpus pipeline in stages: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it was given; the last one
returns packed pieces. Stages judge what their predecessor kept; rows with a null doc_id pass all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.llm import decontaminate, lines, minhash, packing, toxicity
from glasspane.llm.queries import tokenizer_path
from glasspane.llm.shared import Shelf, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the rejection limit; learned from all labels of these documents."""
    return toxicity.accepted(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without recurring lines and passages; a document of which they leave less than a fifth, a near copy, goes."""
    return lines.dedup(docs, passages=True, least_left=0.2)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of common five-word shingles, the one of the smallest doc_id stays."""
    gone = minhash.link(docs, size=5, percent=80).where("not kept").select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__doc"), "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: SQL expresses none of the stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    shelf, docs = Shelf(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
