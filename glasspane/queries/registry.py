"""Where queries register themselves, and the SQL fragments that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PX = """px AS (SELECT vec_id // 64 AS slide_id, (vec_id % 64)::INT AS r, c::INT AS c,
  floor((embedding[c + 1]::DOUBLE + 1.0) * 127.5)::INT AS red,
  floor((embedding[(c + 21) % 64 + 1]::DOUBLE + 1.0) * 127.5)::INT AS green,
  floor((embedding[(c + 42) % 64 + 1]::DOUBLE + 1.0) * 127.5)::INT AS blue FROM embeddings, range(64) t(c))"""
GRAY = "((0.2125::DOUBLE * red + 0.7154::DOUBLE * green + 0.0721::DOUBLE * blue) / 255.0::DOUBLE)"
NINE = "(3 * (red * red + green * green + blue * blue) - (red + green + blue) * (red + green + blue))"


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, without negative zero, so that sums in another order compare equal."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)::DOUBLE"
