"""Page cache: which pages are there already, and which are to be added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.operators.membership import key_filter, may_be_listed, never_listed, only_listed
from pagefacts.plans.staging import stage

PAGE_KEY = ["asin", "page_kind"]


def cache_hits(requested: DataFrame, cached: DataFrame, *, use_cache: bool = True) -> DataFrame:
    if not use_cache:
        return requested.where(F.lit(False))
    return requested.join(cached.select(*PAGE_KEY), PAGE_KEY, "left_semi")


def cache_misses(requested: DataFrame, cached: DataFrame, *, use_cache: bool = True) -> DataFrame:
    if not use_cache:
        return requested
    return requested.join(cached.select(*PAGE_KEY), PAGE_KEY, "left_anti")


def with_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose key is listed, by one plan for lists of any size.

    A filter of bounded size (see ``membership``) drops nearly all others in the scan, so that
    hardly a row is shuffled that is not wanted.
    """
    listed = keys.select(*on)
    return only_listed(may_be_listed(rows, key_filter(listed, on), on), listed, on)


def _without_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose key is whole and not listed; only those that pass the filter of the listed ones are joined."""
    listed = keys.select(*on)
    held = key_filter(listed, on)
    whole = rows.dropna(subset=list(on))
    unsure = may_be_listed(whole, held, on).join(listed, list(on), "left_anti")
    return never_listed(whole, held, on).unionByName(unsure.select(*rows.columns))


def new_keys(keys: DataFrame, cached: DataFrame | None) -> DataFrame:
    """Distinct page keys that the cache does not hold, with the number of their rows; narrow and written."""
    wanted = keys.groupBy(*PAGE_KEY).agg(F.count("*").alias("n_rows"))
    return stage(wanted if cached is None else cache_misses(wanted, cached), "new-keys")


def new_pages(pages: DataFrame, cached: DataFrame | None = None, *, first_by: Column | None = None) -> DataFrame:
    """Pages not in the cache yet, one per identifier and kind.

    The new keys are worked out on narrow rows. Only the pages of keys that occur more than
    once are grouped: the first one by ``first_by`` stays (by default the smallest text). Without ``cached`` all
    others are new, and are not joined.
    """
    wanted = new_keys(pages.select(*PAGE_KEY), cached)
    if cached is None:
        # Dealt out by key, as a cache whose files follow the input's splits is uneven to read.
        once = _without_keys(pages, wanted.where("n_rows > 1"), PAGE_KEY).select(*PAGE_KEY, "html").repartition(*PAGE_KEY)
    else:
        once = with_keys(pages, wanted.where("n_rows = 1"), PAGE_KEY).select(*PAGE_KEY, "html")
    order = F.lit(0) if first_by is None else first_by
    several = with_keys(pages, wanted.where("n_rows > 1"), PAGE_KEY)
    first = several.groupBy(*PAGE_KEY).agg(F.min(F.struct(order.alias("order"), F.col("html"))).alias("page"))
    return once.unionByName(first.select(*PAGE_KEY, "page.html"))
