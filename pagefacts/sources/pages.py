"""Page snapshots: cached pages as one file each, or as a table partitioned by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import schema
from pagefacts.functions.rules import PAGE_KINDS, cache_file, parse_cache_file
from pagefacts.functions.text import clean_page
from pagefacts.operators.cache import new_pages


def snapshot(files: DataFrame, file_name: Column, text: Column, kinds=PAGE_KINDS) -> DataFrame:
    """(asin, page_kind, html) from files and their names; files of other names are left out."""
    return (
        files.select(parse_cache_file(file_name, kinds).alias("key"), clean_page(text).alias("html"))
        .where(F.col("key").isNotNull())
        .select("key.asin", "key.page_kind", "html")
    )


def plain_name(encoded: Column) -> Column:
    """A file name as it is; Spark gives it percent-encoded, plus signs as they are."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def scanned_file_name() -> Column:
    """Plain name of the file a row was read from."""
    return plain_name(F.col("_metadata.file_name"))


def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name) of the files of no bytes, which no scan gives a row for.

    Those listed and those that can be scanned meet by path. No content is read; the listing
    is the one Spark keeps on the driver for any scan.
    """

    def one_form(path: Column) -> Column:
        return F.regexp_replace(path, "^file:/+", "file:/")

    scan = spark.read.format("binaryFile").load(folder)
    listed = spark.createDataFrame([(path,) for path in scan.inputFiles()], "path string").select(one_form(F.col("path")).alias("path"))
    scanned = scan.select(one_form(F.col("_metadata.file_path")).alias("path"))
    empty = listed.join(scanned, "path", "left_anti")
    return empty.select(plain_name(F.element_at(F.split("path", "/"), -1)).alias("file_name"))


def read_page_files(spark: SparkSession, folder: str, kinds=PAGE_KINDS) -> DataFrame:
    """Cached pages of a folder, one file per page.

    For many pages read them once and keep them with ``write_new_pages``: a table has
    far fewer files, and its partitions by kind can be read apart. A file of no bytes is an empty page.
    """
    files = spark.read.text(folder, wholetext=True)
    found = snapshot(files, scanned_file_name(), F.col("value"), kinds)
    return found.unionByName(snapshot(empty_files(spark, folder), F.col("file_name"), F.lit(""), kinds))


def read_page_table(spark: SparkSession, path: str) -> DataFrame:
    """Page cache table; a filter on page_kind prunes folders."""
    return spark.read.schema(schema.PAGE_SNAPSHOT).parquet(path).select(*schema.PAGE_SNAPSHOT.names)


def write_new_pages(pages: DataFrame, path: str, cached: DataFrame | None = None) -> None:
    """Add the pages the cache does not hold yet. Without ``cached`` the cache is new."""
    append_pages(new_pages(pages, cached), path)


def append_pages(pages: DataFrame, path: str) -> None:
    """Add pages to the cache as they are."""
    pages.select("asin", "page_kind", "html").write.partitionBy("page_kind").mode("append").parquet(path)


def with_cache_file(pages: DataFrame, kinds=PAGE_KINDS) -> DataFrame:
    return pages.withColumn("file_name", cache_file(F.col("asin"), F.col("page_kind"), kinds))
