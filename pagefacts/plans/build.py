"""The whole job: identifiers and pages in, three loaded tables and their reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import schema
from pagefacts.functions.rules import PAGE_KINDS, PageKind
from pagefacts.functions.text import clean_page
from pagefacts.operators.cache import PAGE_KEY, cache_misses, with_keys
from pagefacts.operators.crawl import (
    KEY, classify, effective_attempts, fetch_outcome, keep_effective, usable,
)
from pagefacts.operators.extract import extract_all, extract_errors, extract_facts, facts_of
from pagefacts.operators.integrity import pk_violations
from pagefacts.operators.membership import key_filter, may_be_listed, only_listed
from pagefacts.operators.report import report_lines
from pagefacts.plans.manifest import Entry, new_data, publish, read_entry
from pagefacts.plans.staging import stage
from pagefacts.sources.pages import append_pages
from pagefacts.sources.tables import read_table, write_facts, write_ids


def facts_from_log(log: DataFrame, kind: PageKind, **options) -> DataFrame:
    """Facts of the pages a crawl obtained: those of each identifier's settling attempt.

    One scan of the log: each attempt is classified and, if it brought a page, turned
    into facts right there. Only attempts with their facts are shuffled, once, to
    see which of them settled their identifier.
    """
    own = classify(log.where(F.col("page_kind") == kind.name))
    page = F.when(F.col("class") == "ok", F.coalesce("body", F.lit("")))
    attempts = extract_facts(
        own.withColumn("html", page), kind, keep=(*KEY, "seq", "class"), clean=True, drop_missing=False
    )
    settled = keep_effective(attempts, **options).where(F.col("class") == "ok")
    return settled.select(*KEY, "iteration", *kind.fields, "extract_errors")


def cache_from_log(run_log: DataFrame, path: str, cached: DataFrame | None = None, **options) -> None:
    """Add the pages one run obtained to the page cache; of several pages of one key the first obtained.

    The log's bodies are read twice: to classify the attempts, and to write the pages of
    those attempts, settled on narrow rows, that brought a new page.
    """
    attempt = [*KEY, "seq"]
    attempts = stage(classify(run_log).select(*attempt, "class"), "attempts")
    obtained = keep_effective(attempts, **options).where(F.col("class") == "ok")
    first = obtained.groupBy(*PAGE_KEY).agg(F.min(F.struct("seq", "run_id")).alias("first")).select(*PAGE_KEY, "first.*")
    new = stage(first if cached is None else cache_misses(first, cached), "new-pages")
    pages = with_keys(run_log, new, attempt)
    append_pages(pages.select(*PAGE_KEY, clean_page(F.coalesce("body", F.lit(""))).alias("html")), path)


def crawl_outcome(log: DataFrame, **options) -> DataFrame:
    """Outcome per identifier, straight from the log."""
    on_request_error = options.get("on_request_error", "lost")
    return fetch_outcome(effective_attempts(log, **options), on_request_error=on_request_error)


@dataclass(frozen=True)
class Loaded:
    """Where the job left its results; every member is a DataFrame over written tables."""

    root: str
    asins: DataFrame
    product_info: DataFrame
    product_reviews: DataFrame
    extract_errors: DataFrame


def build_tables(
    spark: SparkSession,
    ids: DataFrame,
    pages: DataFrame,
    root: str,
    *,
    recorded_at: Column | None = None,
    validate: bool = False,
) -> Loaded:
    """Replace the three tables under ``root`` with the given identifiers and their facts, in one step at the end.

    A job that fails before leaves the tables as they were.

    ``ids`` must be distinct, as ``read_identifiers`` gives them, and ``pages`` hold one page
    per identifier and kind, as the cache does; repeated ones end the job. ``validate`` leaves out pages that
    hold one of the service's error texts; those of a cache were checked when obtained.

    No page is shuffled, and hardly one is decoded that the list does not ask for: a filter of bounded
    size selects the pages in the scan, and the list itself selects among the narrow fact rows.
    """
    tables = {"asins": write_ids(ids, root, Entry(), recorded_at)}
    asins = read_entry(spark, root, tables["asins"], schema.ASINS)
    # Loading, the error list and the other kind all read the facts; the pages are read once.
    pages = may_be_listed(pages, key_filter(asins, ["asin"]), ["asin"])
    if validate:
        pages = pages.where(usable(F.coalesce("html", F.lit(""))))
    staged = stage(only_listed(extract_all(pages, PAGE_KINDS), asins, ["asin"]), "facts")
    double = pk_violations(staged.select(F.concat_ws(" ", *PAGE_KEY).alias("page")), "page").first()
    if double is not None:
        raise ValueError(f"page {double['page']!r} occurs {double['n_rows']} times")
    errors = Entry()
    for kind in PAGE_KINDS:
        facts = facts_of(staged, kind)
        tables[kind.table] = write_facts(facts, root, kind, Entry(), recorded_at=recorded_at)
        folder = new_data("extract_errors")
        extract_errors(facts, kind).write.parquet(f"{root}/{folder}")
        errors = errors.plus(folder, spark.read.schema(schema.EXTRACT_ERRORS).parquet(f"{root}/{folder}").count())
    publish(spark, root, tables | {"extract_errors": errors})
    return Loaded(
        root=root,
        extract_errors=read_entry(spark, root, errors, schema.EXTRACT_ERRORS),
        **{name: read_entry(spark, root, tables[name], columns) for name, columns in schema.TABLES.items()},
    )


def write_reports(spark: SparkSession, root: str, target: str) -> None:
    """One text report per table, written by the executors in order of the key."""
    for name, columns in schema.TABLES.items():
        lines = report_lines(read_table(spark, root, name), [columns[0].name])
        lines.select("line").write.mode("overwrite").text(f"{target}/{name}")
