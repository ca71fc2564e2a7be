"""Key checks and the joined view of the three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of fact rows that are not facts.
_BOOKKEEPING = ("id", "recorded_at", "asin", "extract_errors")


def pk_violations(table: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once."""
    return table.groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def fk_violations(facts: DataFrame, asins: DataFrame) -> DataFrame:
    """Identifiers of fact rows that the parent table does not know, with their row counts.

    Counted before the join, so an identifier with very many rows joins as one.
    """
    counted = facts.where(F.col("asin").isNotNull()).groupBy("asin").agg(F.count("*").alias("n_rows"))
    return counted.join(asins.select("asin"), "asin", "left_anti")


def latest_facts(facts: DataFrame, order: str = "id") -> DataFrame:
    """One row per identifier: the one loaded last. Combines before the shuffle."""
    fields = [c for c in facts.columns if c not in (*_BOOKKEEPING, order)]
    newest = F.max_by(F.struct(*fields), order).alias("_facts")
    return facts.groupBy("asin").agg(newest).select("asin", "_facts.*")


def product_360(asins: DataFrame, info: DataFrame, reviews: DataFrame, order: str = "id") -> DataFrame:
    """Every identifier with both fact sets, NULL where a page was not obtained.

    Each side has one row per identifier before the joins, so repeated loads
    cannot multiply, and the joins reuse the partitioning of the aggregations.
    """
    return (
        asins.select("asin")
        .join(latest_facts(info, order), "asin", "left")
        .join(latest_facts(reviews, order), "asin", "left")
    )
