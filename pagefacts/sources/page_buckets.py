"""The page cache as a bucketed table: all pages of an identifier lie in the bucket of its hash.

A list of keys then goes to the pages, and not the pages to the list: Spark shuffles the narrow keys into
as many partitions as there are buckets and reads every bucket where its keys are. Bodies are shuffled once, when they are
added. It is for caches that are asked again and again for lists too long to broadcast; the folders by kind of
``sources.pages`` are for scans of everything.

The number of buckets is part of the folder's name, so a reader cannot take another one; it cannot be changed later.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import schema
from pagefacts.operators.cache import PAGE_KEY, new_keys, with_keys

BUCKETS = 200


def _held(spark: SparkSession, path: str) -> int | None:
    """The number of buckets of a cache that is there; by the names of its files."""
    try:
        files = spark.read.schema(schema.PAGE_SNAPSHOT).parquet(f"{path}/buckets-*").inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return int(re.search(r"/buckets-(\d+)/", files[0])[1]) if files else None


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    """Declares the folder as a bucketed table of this session and returns its name."""
    folder = f"{path}/buckets-{buckets}"
    name = f"page_buckets_{hashlib.md5(folder.encode()).hexdigest()}"
    location = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (asin STRING, page_kind STRING, html STRING) USING parquet "
        f"CLUSTERED BY (asin) SORTED BY (page_kind, asin) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    spark.catalog.refreshTable(name)
    return name


def _buckets(spark: SparkSession, path: str) -> int:
    held = _held(spark, path)
    if held is None:
        raise ValueError(f"no page buckets under {path}")
    return held


def read_page_buckets(spark: SparkSession, path: str) -> DataFrame:
    """All pages of a bucketed cache."""
    return spark.table(_table(spark, path, _buckets(spark, path)))


def pages_of(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The pages of a bucketed cache whose keys (asin, page_kind) are listed; no page is shuffled.

    They meet by identifier, which the buckets are made of; the kind is compared afterwards. The keys are dealt
    to as many partitions as there are buckets, else Spark might rather shuffle the pages.
    """
    dealt = keys.select(*PAGE_KEY).repartition(_buckets(spark, path), "asin")
    kinds = dealt.groupBy("asin").agg(F.collect_set("page_kind").alias("_kinds"))
    met = read_page_buckets(spark, path).join(kinds, "asin").where(F.array_contains("_kinds", F.col("page_kind")))
    return met.select(*PAGE_KEY, "html")


def add_to_buckets(pages: DataFrame, path: str, *, buckets: int = BUCKETS) -> None:
    """Add the pages that a bucketed cache does not hold yet, the smallest text of a repeated key.

    ``buckets`` is for a new cache; one that is there keeps its own. What is new is found on narrow keys; only new pages
    are shuffled, once, to their buckets.
    """
    spark = pages.sparkSession
    held = _held(spark, path)
    wanted = new_keys(pages.select(*PAGE_KEY), None if held is None else read_page_buckets(spark, path).select(*PAGE_KEY))
    buckets = held or buckets
    found = with_keys(pages, wanted, PAGE_KEY)
    first = found.repartition(buckets, "asin").groupBy("asin", "page_kind").agg(F.min("html").alias("html"))
    rows = first.select(*PAGE_KEY, "html")
    (
        rows.write.format("parquet").mode("append").bucketBy(buckets, "asin").sortBy("page_kind", "asin")
        .saveAsTable(_table(spark, path, buckets))
    )
