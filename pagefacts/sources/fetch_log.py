"""Fetch log: one row per attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagefacts import schema


def read_fetch_log(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(schema.FETCH_LOG).format(format).load(path)
