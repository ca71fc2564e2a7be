
from __future__ import annotations

import sys
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import driver_tables as given  # noqa: E402
import oracles  # noqa: E402
from pagefacts import fixed_values as fixed  # noqa: E402
from pagefacts import schema  # noqa: E402
from pagefacts.functions.rules import (  # noqa: E402
    INFO, PAGE_KINDS, REVIEWS, ExtractRule, PageKind, cache_file, parse_cache_file, target_url,
)
from pagefacts.functions.text import html_unescape, to_float, to_int  # noqa: E402
from pagefacts.operators import cache, crawl, extract, integrity, ordered, report  # noqa: E402
from pagefacts.plans import build, job, staging  # noqa: E402
from pagefacts.sources import fetch_log, identifiers, page_buckets, pages, tables  # noqa: E402
from pagefacts.streaming import outcomes as stream_outcomes  # noqa: E402
from pagefacts.streaming import pages as stream_pages  # noqa: E402

try:
    import corpus_pipeline  # noqa: E402
    from pagefacts.llm import queries as llm_queries  # noqa: E402
except ModuleNotFoundError as missing:
    # The subpackage and its pipeline are optional; another missing module is an error.
    if missing.name not in ("corpus_pipeline", "pagefacts.llm"):
        raise
    llm_queries = corpus_pipeline = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"


def _with_folder(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        staging.ensure_shared_folder(spark)
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    return _with_folder(product_360)(spark, FLAGSHIP_DIR)


# Sources


def id_ingest(spark, sf_dir):
    return identifiers.identifiers(given.id_lines(spark, sf_dir))


def id_records(spark, sf_dir):
    """A list whose records go over several lines, as files."""
    path = staging.new_folder(spark, "records")
    given.id_records(spark, sf_dir).write.text(path)
    return identifiers.read_identifiers(spark, path)


def cache_scan(spark, sf_dir):
    """Product pages as cached files hold them: byte order mark, Windows line ends, a file name."""
    named = pages.with_cache_file(given.product_pages(spark, sf_dir))
    stored = F.concat(F.lit("\ufeff"), F.replace("html", F.lit("\n"), F.lit("\r\n")))
    files = staging.stage(named.select("file_name", stored.alias("value")), "page-files")
    return pages.snapshot(files, F.col("file_name"), F.col("value"))


def fetch_log_scan(spark, sf_dir):
    """The fetch log as a crawl leaves it: files, read with the declared schema."""
    path = staging.new_folder(spark, "fetch-log")
    given.fetch_log(spark, sf_dir).write.parquet(path)
    return fetch_log.read_fetch_log(spark, path)


def table_scan(spark, sf_dir):
    return tables.scan_table(spark, _loaded(spark, sf_dir, REVIEWS), "product_reviews")


# Sinks


def _loaded(spark, sf_dir, kind):
    """Root of fresh tables with the part identifiers and the facts of one page kind."""
    root = staging.new_folder(spark, "tables")
    tables.create_tables(spark, root)
    tables.load_ids(given.part_ids(spark, sf_dir), root, given.recorded_at())
    source = given.product_pages if kind is INFO else given.review_pages
    facts = extract.extract_facts(source(spark, sf_dir), kind, on_error="null")
    tables.load_facts(staging.stage(facts, "facts"), root, kind, recorded_at=given.recorded_at())
    return root


def schema_tables(spark, sf_dir):
    """Tables filled, replaced by empty ones, and filled again: nothing is doubled."""
    root = staging.new_folder(spark, "tables")
    tables.create_tables(spark, root)
    tables.load_ids(id_ingest(spark, sf_dir), root)
    built = build.build_tables(spark, given.listed_ids(spark, sf_dir), given.all_pages(spark, sf_dir), root)
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(schema.TABLES[name])).alias("n_columns"), "n_rows"
        )
        for name, df in (
            ("asins", built.asins),
            ("product_info", built.product_info),
            ("product_reviews", built.product_reviews),
        )
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def load_ids(spark, sf_dir):
    root = staging.new_folder(spark, "tables")
    tables.create_tables(spark, root)
    tables.load_ids(id_ingest(spark, sf_dir), root, given.recorded_at())
    return tables.read_table(spark, root, "asins")


def load_ids_rejected(spark, sf_dir):
    """Part identifiers are loaded; the events' list, with its repeats, is refused for these."""
    root = staging.new_folder(spark, "tables")
    tables.create_tables(spark, root)
    tables.load_ids(given.part_ids(spark, sf_dir), root, given.recorded_at())
    more = given.id_lines(spark, sf_dir).withColumnRenamed("value", "asin")
    try:
        tables.load_ids(more, root)
    except ValueError:
        return tables.rejected_ids(more, tables.read_table(spark, root, "asins"))
    raise AssertionError("a repeated identifier was loaded")


def load_product_info(spark, sf_dir):
    return tables.read_table(spark, _loaded(spark, sf_dir, INFO), "product_info")


def load_product_reviews(spark, sf_dir):
    return tables.read_table(spark, _loaded(spark, sf_dir, REVIEWS), "product_reviews")


def cache_new_pages(spark, sf_dir):
    """A cache of the pages obtained so far, then all pages added to it."""
    folder = staging.new_folder(spark, "cache")
    keys = staging.stage(_cached(spark, sf_dir), "obtained-keys")
    obtained = cache.cache_hits(given.product_pages(spark, sf_dir), keys)
    pages.write_new_pages(obtained, folder)
    held = pages.read_page_table(spark, folder)
    pages.write_new_pages(given.all_pages(spark, sf_dir), folder, held)
    return pages.read_page_table(spark, folder)


def cache_buckets(spark, sf_dir):
    """A bucketed cache filled in two steps, and the pages in it of a list of keys."""
    folder = staging.new_folder(spark, "buckets")
    page_buckets.add_to_buckets(given.product_pages(spark, sf_dir), folder, buckets=16)
    page_buckets.add_to_buckets(given.all_pages(spark, sf_dir), folder)
    return page_buckets.pages_of(spark, folder, _ids_by_kind(given.listed_ids(spark, sf_dir)))


def job_tables(spark, sf_dir):
    """The whole job from its command line: product facts, and whether they have the load's time."""
    ids, cached, root = (staging.new_folder(spark, n) for n in ("records", "cache", "tables"))
    given.id_records(spark, sf_dir).write.text(ids)
    pages.write_new_pages(given.all_pages(spark, sf_dir), cached)
    now = "SELECT localtimestamp() AS now"
    started = spark.sql(now).first()["now"]
    job.run(spark, job.arguments(["-i", ids, "--pages", cached, "--tables", root]))
    in_time = F.col("recorded_at").between(F.lit(started), F.lit(spark.sql(now).first()["now"]))
    loaded = tables.read_table(spark, root, "product_info")
    return loaded.withColumn("in_time", in_time).drop("recorded_at")


# Projections


def column_names(spark, sf_dir):
    """Column names with their table and schema before them."""
    name = F.concat(F.lit("public."), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("."), "p_name")
    named = given.table(spark, sf_dir, "part").select("p_partkey", name.alias("qualified"))
    return named.withColumn("name", report.column_name(F.col("qualified")))


def _ids_by_kind(ids):
    return ids.select("asin", F.explode(F.array(F.lit("info"), F.lit("reviews"))).alias("page_kind"))


def target_urls(spark, sf_dir):
    ids = _ids_by_kind(id_ingest(spark, sf_dir))
    return ids.withColumn("url", target_url(F.col("asin"), F.col("page_kind")))


def cache_key(spark, sf_dir):
    named = pages.with_cache_file(_ids_by_kind(id_ingest(spark, sf_dir)))
    parsed = parse_cache_file(F.col("file_name"))
    return named.select(
        "*", parsed["asin"].alias("parsed_asin"), parsed["page_kind"].alias("parsed_kind")
    )


def page_quality(spark, sf_dir):
    crawled = given.table(spark, sf_dir, "pages").select(
        F.lit("page").alias("source"), F.col("page_id").alias("id"), crawl.usable(F.col("html")).alias("usable")
    )
    replies = given.fetch_log(spark, sf_dir).where(F.col("status") == 200)
    return crawled.unionByName(
        replies.select(
            F.lit("reply").alias("source"), F.col("seq").alias("id"), crawl.usable(F.col("body")).alias("usable")
        )
    )


def classify_response(spark, sf_dir):
    return crawl.classify(given.fetch_log(spark, sf_dir)).select(*crawl.KEY, "seq", "class")


def ok_pages(spark, sf_dir):
    return crawl.ok_pages(given.fetch_log(spark, sf_dir))


def unescape(spark, sf_dir):
    return given.table(spark, sf_dir, "pages").select("page_id", html_unescape(F.col("html")).alias("text"))


def regex_extract(spark, sf_dir):
    """Own rules over the crawled pages: another group, a converter, a default."""
    rules = [
        ExtractRule("product_name", fixed.PRODUCT_NAME, target_group=1),
        ExtractRule("lang", r'<html lang="(.*?)">'),
        ExtractRule("track", r"track\((\d+)\)", convert=to_int),
        ExtractRule("missing", r"<blink>(.*?)</blink>", convert=to_int, default=-1),
    ]
    return extract.extract(given.table(spark, sf_dir, "pages"), rules, keep=["page_id"], on_error="null")


def own_page_kind(spark, sf_dir):
    """A further kind of page beside the others in one scan: its rules, addresses and cache files."""
    crawled = PageKind(
        "crawled", "https://example.com/crawled/{}", "crawled-{}.html",
        (ExtractRule("lang", r'<html lang="(.*?)">'), ExtractRule("track", r"track\((\d+)\)", convert=to_int, default=0)),
        "crawled_pages",
    )
    kinds = (*PAGE_KINDS, crawled)
    asin = given.identifier(F.col("page_id")).alias("asin")
    own = given.table(spark, sf_dir, "pages").select(asin, F.lit("crawled").alias("page_kind"), "html")
    every = given.all_pages(spark, sf_dir).unionByName(own)
    facts = extract.facts_of(extract.extract_all(every, kinds, on_error="null"), crawled)
    named = facts.withColumn("kind", F.lit(crawled.name))
    file_name = cache_file(F.col("asin"), F.col("kind"), kinds)
    return named.select(
        "*", target_url(F.col("asin"), F.col("kind"), kinds).alias("url"), file_name.alias("file_name"),
        parse_cache_file(file_name, kinds)["page_kind"].alias("parsed_kind"),
    )


def _field(kind, name):
    def query(spark, sf_dir):
        source = given.product_pages if kind is INFO else given.review_pages
        return extract.extract_facts(source(spark, sf_dir), kind, [name], on_error="null")

    return query


def extract_errors(spark, sf_dir):
    """Pages whose number of ratings is a word."""
    facts = extract.extract_facts(given.product_pages(spark, sf_dir, ratings=F.col("p_brand")), INFO)
    return extract.extract_errors(facts, INFO)


def _raw_numbers(spark, sf_dir):
    """Texts made from part columns that do and do not hold a number."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    forms = {
        "grouped": F.concat(F.lit("  "), F.format_number(key * 1000003, 0), F.lit("\n")),
        "decimal": F.concat(F.lit(" "), F.col("p_retailprice").cast("string")),
        "negative": F.concat(F.lit("-"), size, F.lit(" ")),
        "suffix": F.concat(size, F.lit("d")),
        "words": F.col("p_name"),
    }
    part = given.table(spark, sf_dir, "part").select(key, *[c.alias(name) for name, c in forms.items()])
    return part.unpivot(["p_partkey"], list(forms), "form", "raw")


def to_int_query(spark, sf_dir):
    return _raw_numbers(spark, sf_dir).withColumn("value", to_int(F.col("raw")).cast("bigint"))


def to_float_query(spark, sf_dir):
    return _raw_numbers(spark, sf_dir).withColumn("value", to_float(F.col("raw")))


def product_info_facts(spark, sf_dir):
    return extract.extract_facts(given.product_pages(spark, sf_dir), INFO, on_error="null")


def product_reviews_facts(spark, sf_dir):
    return extract.extract_facts(given.review_pages(spark, sf_dir), REVIEWS, on_error="null")


def fact_listing(spark, sf_dir):
    return extract.fact_listing(product_info_facts(spark, sf_dir), INFO)


# Joins


def fk_violations(spark, sf_dir):
    return integrity.fk_violations(product_info_facts(spark, sf_dir), id_ingest(spark, sf_dir))


def _cached(spark, sf_dir):
    """Keys of the pages some run has obtained."""
    outcome = build.crawl_outcome(given.fetch_log(spark, sf_dir))
    return outcome.where(F.col("outcome") == "ok").select("asin", "page_kind").distinct()


def cache_hits(spark, sf_dir):
    requested = _ids_by_kind(given.part_ids(spark, sf_dir))
    return cache.cache_hits(requested, _cached(spark, sf_dir))


def cache_misses(spark, sf_dir):
    requested = _ids_by_kind(given.part_ids(spark, sf_dir))
    return cache.cache_misses(requested, _cached(spark, sf_dir))


def retry_worklist(spark, sf_dir):
    log = given.fetch_log(spark, sf_dir)
    return crawl.retry_worklist(log, build.crawl_outcome(log))


def product_360(spark, sf_dir):
    """All part identifiers, product facts from the pages the crawl obtained, review facts from snapshots."""
    log = given.fetch_log_with_pages(spark, sf_dir)
    info = build.facts_from_log(log, INFO).select("run_id", "asin", *INFO.fields)
    reviews = extract.extract_facts(given.review_pages(spark, sf_dir), REVIEWS).withColumn("run_id", F.lit(""))
    return integrity.product_360(given.part_ids(spark, sf_dir), info, reviews, order="run_id")


# Aggregations and windows


def _page_titles(spark, sf_dir):
    rules = [ExtractRule("product_name", fixed.PRODUCT_NAME, target_group=1)]
    return extract.extract(given.table(spark, sf_dir, "pages"), rules, keep=["page_id", "url"], on_error="null")


def report_widths(spark, sf_dir):
    return report.report_widths(_page_titles(spark, sf_dir))


def _effective(spark, sf_dir):
    return crawl.effective_attempts(given.fetch_log(spark, sf_dir))


def iteration_summary(spark, sf_dir):
    return crawl.iteration_summary(_effective(spark, sf_dir))


def fetch_outcome(spark, sf_dir):
    return crawl.fetch_outcome(_effective(spark, sf_dir))


def unscraped_ids(spark, sf_dir):
    return crawl.unscraped(fetch_outcome(spark, sf_dir))


def invalid_ids(spark, sf_dir):
    return crawl.invalid(fetch_outcome(spark, sf_dir))


def failed_ids(spark, sf_dir):
    return crawl.failed(fetch_outcome(spark, sf_dir))


def pk_violations(spark, sf_dir):
    lines = given.id_lines(spark, sf_dir).withColumnRenamed("value", "asin")
    return integrity.pk_violations(lines, "asin")


def attempt_iteration(spark, sf_dir):
    return crawl.attempt_iteration(given.fetch_log(spark, sf_dir))


def attempt_position(spark, sf_dir):
    return crawl.attempt_position(_effective(spark, sf_dir))


def adaptive_delay(spark, sf_dir):
    return crawl.adaptive_delay(_effective(spark, sf_dir))


def planned_wait(spark, sf_dir):
    return crawl.planned_wait(adaptive_delay(spark, sf_dir))


def surrogate_id(spark, sf_dir):
    """Ids of obtained pages in load order: by run, retried identifiers after the others."""
    got = _effective(spark, sf_dir).where(F.col("class") == "ok").select("run_id", "iteration", "asin")
    return ordered.with_dense_id(got, ["run_id", "iteration", "asin"])


# Report


def report_cells(spark, sf_dir):
    return report.report_cells(_page_titles(spark, sf_dir), keep=["page_id"]).withColumnRenamed("_key_page_id", "key")


def report_doubles(spark, sf_dir):
    """Numbers on both sides of the limits between plain digits and an exponent."""
    price = F.col("p_retailprice")
    sizes = {"plain": 1.0, "large": 1e5, "huge": 1e14, "small": 1e-6, "tiny": 1e-9}
    numbers = given.table(spark, sf_dir, "part").select(
        "p_partkey", *[(price * factor).alias(name) for name, factor in sizes.items()]
    )
    return report.report_cells(numbers, keep=["p_partkey"]).drop("p_partkey").withColumnRenamed("_key_p_partkey", "key")


def report_lines(spark, sf_dir):
    return report.report_lines(load_product_info(spark, sf_dir), ["id"])


# Streaming


def stream_facts(spark, sf_dir):
    arriving, root, checkpoint = (staging.new_folder(spark, n) for n in ("arriving", "tables", "checkpoint"))
    given.all_pages(spark, sf_dir).write.parquet(arriving)
    source = stream_pages.page_table_stream(spark, arriving)
    listed = staging.stage(given.listed_ids(spark, sf_dir), "listed")
    query = stream_pages.stream_facts(
        source, listed, root, checkpoint, recorded_at=given.recorded_at(), on_unknown="drop"
    )
    query.awaitTermination()
    info, reviews = (stream_pages.loaded_facts(spark, root, kind).drop("batch_id") for kind in (INFO, REVIEWS))
    return info.unionByName(reviews, allowMissingColumns=True)


def stream_outcome_rows(spark, sf_dir):
    arriving, root, checkpoint = (staging.new_folder(spark, n) for n in ("arriving", "outcomes", "checkpoint"))
    given.fetch_log(spark, sf_dir).write.parquet(arriving)
    log = spark.readStream.schema(schema.FETCH_LOG).parquet(arriving)
    stream_outcomes.stream_outcomes(log, root, checkpoint).awaitTermination()
    stream_outcomes.close_runs(spark, root)
    return stream_outcomes.outcomes(spark, root)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        "id_ingest": id_ingest,
        "id_records": id_records,
        "cache_scan": cache_scan,
        "table_scan": table_scan,
        "fetch_log_scan": fetch_log_scan,
        "schema_tables": schema_tables,
        "load_ids": load_ids,
        "load_ids_rejected": load_ids_rejected,
        "load_product_info": load_product_info,
        "load_product_reviews": load_product_reviews,
        "cache_new_pages": cache_new_pages,
        "cache_buckets": cache_buckets,
        "job_tables": job_tables,
        "column_names": column_names,
        "own_page_kind": own_page_kind,
        "target_url": target_urls,
        "cache_key": cache_key,
        "page_quality": page_quality,
        "classify_response": classify_response,
        "ok_pages": ok_pages,
        "html_unescape": unescape,
        "regex_extract": regex_extract,
        "extract_errors": extract_errors,
        "to_int": to_int_query,
        "to_float": to_float_query,
        "product_info_facts": product_info_facts,
        "product_reviews_facts": product_reviews_facts,
        "fact_listing": fact_listing,
        "fk_violations": fk_violations,
        "cache_hits": cache_hits,
        "cache_misses": cache_misses,
        "retry_worklist": retry_worklist,
        "product_360": product_360,
        "report_widths": report_widths,
        "iteration_summary": iteration_summary,
        "fetch_outcome": fetch_outcome,
        "unscraped_ids": unscraped_ids,
        "invalid_ids": invalid_ids,
        "failed_ids": failed_ids,
        "pk_violations": pk_violations,
        "effective_attempts": _effective,
        "attempt_iteration": attempt_iteration,
        "attempt_position": attempt_position,
        "adaptive_delay": adaptive_delay,
        "planned_wait": planned_wait,
        "surrogate_id": surrogate_id,
        "report_cells": report_cells,
        "report_doubles": report_doubles,
        "report_lines": report_lines,
        "stream_facts": stream_facts,
        "stream_outcomes": stream_outcome_rows,
    }
    for kind in (INFO, REVIEWS):
        for field in kind.fields:
            named[f"extract_{field}"] = _field(kind, field)
    if llm_queries:
        named |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return {name: _with_folder(query) for name, query in named.items()}


def oracle_sql() -> dict[str, str]:
    expected = oracles.oracle_sql()
    if llm_queries:
        expected |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            expected["pipeline"] = corpus_pipeline.ORACLE_SQL
    return expected
