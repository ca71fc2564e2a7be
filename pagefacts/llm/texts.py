"""What several operators need: a row's key, words, and binding of intermediate values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words: the blank and the control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of (doc_id, text). Rows that agree in both are the same document to every operator."""
    return F.struct(
        F.xxhash64(doc_id, text).alias("a"),
        F.xxhash64(F.lit("key"), text, doc_id).alias("b"),
    )
