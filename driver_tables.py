"""Inputs for the registered queries, derived from the given tables (see FIXTURES.md §3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.fixed_values import ROBOT_CHECK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identifier(key: Column) -> Column:
    return F.concat(F.lit("B"), F.lpad(key.cast("string"), 9, "0"))


def recorded_at() -> Column:
    return F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")


def id_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text line per event, so identifiers repeat."""
    return table(spark, sf_dir, "events").select(identifier(F.col("user_id")).alias("value"))


def id_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV records of three columns; quoted ones have line breaks, quotes and commas. One text row per record."""
    key = F.col("p_partkey")
    name = F.concat(F.lit('"'), "p_name", F.lit('\n""'), "p_brand", F.lit('"", '), "p_type", F.lit('"'))
    last = (
        F.when(key % 3 == 0, F.concat(F.lit('"'), identifier(key), F.lit('\n""'), "p_brand", F.lit('"""')))
        .when(key % 5 == 0, F.concat(F.lit('"'), identifier(key), F.lit('"')))
        .otherwise(identifier(key))
    )
    return table(spark, sf_dir, "part").select(F.concat_ws(",", key.cast("string"), name, last).alias("value"))


def part_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(identifier(F.col("p_partkey")).alias("asin"))


def listed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of the parts."""
    return part_ids(spark, sf_dir).where(~F.endswith("asin", F.lit("7")))


def _present(absent: Column, text: Column) -> Column:
    return F.when(absent, F.lit("")).otherwise(text)


def product_pages(spark: SparkSession, sf_dir: str, ratings: Column | None = None) -> DataFrame:
    """One product page per part; some pages lack a fact. ``ratings`` replaces the number of ratings."""
    key, size = F.col("p_partkey"), F.col("p_size")
    if ratings is None:
        ratings = F.format_number(key * 37, 0)
    answered = size * 25
    html = F.concat(
        F.lit("<html><head><title>Amazon.com : "), "p_brand", F.lit(" &amp; "), "p_name",
        F.lit(" - - Amazon.com</title></head><body>\n"),
        _present(key % 7 == 0, F.concat(
            F.lit('<span id="acrCustomerReviewText" class="a-size-base">'), ratings, F.lit(" ratings</span>\n"))),
        _present(key % 11 == 0, F.concat(
            F.lit('<span id="acrPopover" class="reviewCountTextLinkedHistogram noUnderline" title="'),
            F.format_string("%.1f", (10 + size % 41) / 10), F.lit(' out of 5 stars">\n'))),
        F.lit('<span class="a-size-base">\n'), answered.cast("string"),
        F.when(answered >= 1000, "+").otherwise(""), F.lit(" answered questions\n</span></body></html>"),
    )
    return table(spark, sf_dir, "part").select(
        identifier(key).alias("asin"), F.lit("info").alias("page_kind"), html.alias("html")
    )


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reviews page per part, each fact on its own line; some pages lack a fact."""
    key = F.col("p_partkey")

    def count(factor):
        return F.format_number(key * factor, 0)

    html = F.concat(
        F.lit("<html><body>\n"),
        _present(key % 5 == 0, F.concat(F.lit("<span>Showing 1-10 of "), count(41), F.lit(" reviews</span>\n"))),
        _present(key % 6 == 0, F.concat(F.lit("<a>See all "), count(29), F.lit(" positive reviews</a>\n"))),
        _present(key % 8 == 0, F.concat(F.lit("<a>See all "), count(12), F.lit(" critical reviews</a>\n"))),
        F.lit("</body></html>"),
    )
    return table(spark, sf_dir, "part").select(
        identifier(key).alias("asin"), F.lit("reviews").alias("page_kind"), html.alias("html")
    )


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_pages(spark, sf_dir).unionByName(review_pages(spark, sf_dir))


def fetch_log(spark: SparkSession, sf_dir: str, page: Column | None = None) -> DataFrame:
    """One attempt per event. ``page`` replaces the body of obtained pages.

    Two thirds of the attempts are one run, the others one run per day. A quarter of the
    identifiers stand for reviews pages, and a tenth never get a reply, however often they are tried.
    """
    event, user = F.col("event_type"), F.col("user_id")
    silent = user % 10 == 9
    if page is None:
        page = F.concat(F.lit("<html>event "), F.col("event_id").cast("string"), F.lit("</html>"))
    obtained = event.isin("view", "purchase") & ~silent
    even = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 2 == 0
    status = (
        F.when(silent, 503)
        .when(obtained | (event == "click"), 200)
        .when(event == "signup", 404)
        .when((event == "error") & ~even, 502)
    )
    body = F.when(obtained, page).when((event == "click") & ~silent, F.lit(f"<p>{ROBOT_CHECK}</p>"))
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("backfill").alias("run_id"),
        F.when(user % 4 == 3, "reviews").otherwise("info").alias("page_kind"),
        identifier(F.col("user_id")).alias("asin"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        body.alias("body"),
    )


def fetch_log_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch log with product pages as the bodies of obtained pages."""
    pages = product_pages(spark, sf_dir).select("asin", "html")
    log = fetch_log(spark, sf_dir, page=F.lit(""))
    return log.join(pages, "asin", "left").withColumn(
        "body", F.when(F.col("body") == "", F.col("html")).otherwise(F.col("body"))
    ).drop("html")
