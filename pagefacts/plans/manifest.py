"""Versions of a set of tables under one root: a small file names what is current.

``manifest/version=N`` holds one row per table: its folders, the number of its rows and its last id. Data is written
to folders of its own and counts once a manifest names it; a manifest is a single file, which
appears whole or not at all. So a job that fails leaves the version before it, readers of which are not
disturbed, and a load takes the counts it goes on from out of the manifest instead of the data.
One writer at a time: a version that is there already is refused.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_COLUMNS = "table string, folders array<string>, n_rows bigint, last_id bigint"


@dataclass(frozen=True)
class Entry:
    """What a version knows of a table; folders are given from the root."""

    folders: tuple[str, ...] = ()
    n_rows: int = 0
    last_id: int = 0

    def plus(self, folder: str, n_rows: int, last_id: int = 0) -> Entry:
        return Entry((*self.folders, folder), self.n_rows + n_rows, max(self.last_id, last_id))


def current_version(spark: SparkSession, root: str) -> int:
    """-1 if there is none. Reads names of files, no data."""
    try:
        files = spark.read.schema(_COLUMNS).parquet(f"{root}/manifest/version=*").inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = []
    return max((int(re.search(r"/version=(\d+)/", file)[1]) for file in files), default=-1)


def entries(spark: SparkSession, root: str, version: int | None = None) -> dict[str, Entry]:
    """Tables of a version, by default the current one."""
    version = current_version(spark, root) if version is None else version
    if version < 0:
        return {}
    rows = spark.read.schema(_COLUMNS).parquet(f"{root}/manifest/version={version}").collect()
    return {row["table"]: Entry(tuple(row["folders"]), row["n_rows"], row["last_id"]) for row in rows}


def publish(spark: SparkSession, root: str, tables: dict[str, Entry]) -> None:
    """Make these tables the current version."""
    version = current_version(spark, root) + 1
    rows = [(name, list(entry.folders), entry.n_rows, entry.last_id) for name, entry in tables.items()]
    spark.createDataFrame(rows, _COLUMNS).coalesce(1).write.parquet(f"{root}/manifest/version={version}")


def new_data(table: str) -> str:
    """A folder no version names yet."""
    return f"{table}/{uuid.uuid4().hex}"


def read_entry(spark: SparkSession, root: str, entry: Entry, columns: T.StructType) -> DataFrame:
    if not entry.folders:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(*[f"{root}/{folder}" for folder in entry.folders])


def empty_old_versions(spark: SparkSession, root: str) -> None:
    """Empty the data that only earlier versions name, once no reader needs them."""
    version = current_version(spark, root)
    kept = {folder for entry in entries(spark, root, version).values() for folder in entry.folders}
    old = {f for v in range(version) for entry in entries(spark, root, v).values() for f in entry.folders}
    for folder in old - kept:
        spark.createDataFrame([], "emptied int").write.mode("overwrite").parquet(f"{root}/{folder}")
