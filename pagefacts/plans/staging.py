"""Intermediate tables.

A narrow result that several later steps read is written once, as parquet, to the
shared folder the cluster names in ``spark.checkpoint.dir``. That cuts the lineage,
survives lost executors, and gives the later steps column pruning and real sizes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        raise RuntimeError(f"set {_SETTING} to a folder all executors share")
    return folder.rstrip("/")


def ensure_shared_folder(spark: SparkSession) -> None:
    """For entry points: a local session that names no folder, as in tests, gets one of its own."""
    if not spark.conf.get(_SETTING, None) and re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        spark.conf.set(_SETTING, tempfile.mkdtemp(prefix="pagefacts-"))


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/pagefacts/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to a fresh staging table and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    if (own := _scratch.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Empty the tables that are staged inside when it ends; what needs them must be written by then."""
    paths: list[str] = []
    outer = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(outer)
        for path in paths:
            spark.createDataFrame([], "emptied int").write.mode("overwrite").parquet(path)
