"""Extraction: literal pages, matching rules, conversion failures, plan shape."""

import pandas as pd
import pytest
from conftest import physical_plan
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagefacts.fixed_values import ROBOT_CHECK
from pagefacts.functions.rules import INFO, PAGE_KINDS, REVIEWS, ExtractRule, PageKind, cache_file, parse_cache_file
from pagefacts.functions.text import to_int
from pagefacts.operators.extract import extract, extract_all, extract_errors, extract_facts, fact_listing, facts_of


def facts(spark, kind, pages, **options):
    """List of fact rows, one per page, in order."""
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "asin string, html string")
    rows = extract_facts(df, kind, **options).collect()
    return sorted(rows, key=lambda row: int(row["asin"]))


def column(spark, kind, field, pages, **options):
    return [row[field] for row in facts(spark, kind, pages, **options)]


def test_product_name(spark):
    cases = {
        "": None,
        "<title>Amazon.com: Product Name</title>": "Product Name",
        "<title>Amazon.com : Product Name</title>": "Product Name",
        "<title>Product Name - - Amazon.com</title>": "Product Name",
        "<title>Amazon.com: Product &quot; &amp; Name</title>": 'Product " & Name',
        "<title>Amazon.com:  Name</title>": "Name",
        "<title>Amazon.com\x1f: Name</title>": "Name",
        "<title>  spaced  </title>": "  spaced  ",
        '<title dir="ltr">Name</title>': None,
        "&lt;title&gt;Hidden&lt;/title&gt;": "Hidden",
        "<title>One</title><title>Two</title>": "One",
        "<title></title> and </title>": "</title> and ",
        "<title>two\nlines</title>": None,
        "<title>a\r\u0085 b</title>": "a\r\u0085 b",
    }
    assert column(spark, INFO, "product_name", cases) == list(cases.values())


def test_ratings(spark):
    span = '<span id="acrCustomerReviewText" class="a-size-base">{} ratings</span>'
    cases = {span.format("1,775"): 1775, "": 0, span.format(" 12 "): 12, span.replace("ratings", "rating"): 0}
    assert column(spark, INFO, "total_ratings", cases) == list(cases.values())


def test_average(spark):
    span = (
        '<span id="acrPopover" class="reviewCountTextLinkedHistogram noUnderline" title="{} out of 5 stars">'
    )
    cases = {span.format("4.0"): 4.0, "": None, span.format("4,5"): None}
    assert column(spark, INFO, "average_rating", cases) == list(cases.values())


def test_answered_questions(spark):
    cases = {
        "": 0,
        '\n<span class="a-size-base">\n37 answered questions\n</span>\n': 37,
        '\n<span class="a-size-base">\n1000+ answered questions\n</span>\n': 1000,
        '<span class="a-size-base">\r\n37 answered questions\r\n</span>': 0,
    }
    assert column(spark, INFO, "answered_questions", cases) == list(cases.values())


def test_reviews(spark):
    page = (
        'class="a-size-base">Showing 1-10 of 1,863 reviews</span>\n'
        'filterByStar=positive">See all 1,664 positive reviews</a>\n'
        'filterByStar=critical">See all 199 critical reviews</a>'
    )
    rows = facts(
        spark, REVIEWS, [page, "", "Showing 1,001-1,010 of 9 reviews", "Showing 1–10 of 9 reviews", "Showing １ of 7 reviews"]
    )
    values = [(r.total_reviews, r.positive_reviews, r.critical_reviews) for r in rows]
    assert values == [(1863, 1664, 199), (0, 0, 0), (0, 0, 0), (0, 0, 0), (7, 0, 0)]


def test_counts_that_do_not_add_up_stay(spark):
    page = "Showing 1-10 of 5 reviews\nSee all 9 positive reviews"
    row = facts(spark, REVIEWS, [page])[0]
    assert (row.total_reviews, row.positive_reviews, row.critical_reviews) == (5, 9, 0)


def test_robot_page_gives_defaults(spark):
    page = f'<html><head><title dir="ltr">Robot Check</title></head><p>{ROBOT_CHECK}</p></html>'
    row = facts(spark, INFO, [page])[0]
    assert (row.product_name, row.total_ratings, row.average_rating, row.answered_questions) == (None, 0, None, 0)


def test_lazy_group_may_run_over_prose(spark):
    page = "See all offers and 12 positive reviews"
    df = spark.createDataFrame([("B1", page)], "asin string, html string")
    result = extract_facts(df, REVIEWS)
    assert result.first()["positive_reviews"] is None
    errors = [tuple(r) for r in extract_errors(result, REVIEWS).collect()]
    assert errors == [("B1", "reviews", "positive_reviews", "offers and 12")]
    assert extract_facts(df, REVIEWS, on_error="null").first()["positive_reviews"] is None
    with pytest.raises(PySparkException, match="positive_reviews"):
        extract_facts(df, REVIEWS, on_error="fail").collect()
    with pytest.raises(ValueError):
        extract_facts(df, REVIEWS, on_error="guess")


def test_page_not_obtained_gives_no_row(spark):
    df = spark.createDataFrame([("B1", None), ("B2", "")], "asin string, html string")
    assert [r.asin for r in extract_facts(df, INFO).collect()] == ["B2"]


def test_own_rules(spark):
    df = spark.createDataFrame([("B1", "a=1,5;b=&amp;"), ("B2", "none")], "asin string, html string")
    rules = [
        ExtractRule("a", r"(a)=([\d,]+)", target_group=1, convert=to_int, default=-1),
        ExtractRule("b", r"b=(.*)", convert=F.upper),
        ExtractRule("empty", r"n(x*)one"),
    ]
    rows = {r.asin: tuple(r)[1:] for r in extract(df, rules, on_error="null").collect()}
    assert rows == {"B1": (15, "&", None), "B2": (-1, None, "")}
    raw = extract(df, rules, decode=False, on_error="null").where("asin = 'B1'").first()
    assert raw["b"] == "&AMP;"


def test_converter_may_be_a_pandas_udf(spark):
    @F.pandas_udf("string")
    def backwards(texts: pd.Series) -> pd.Series:
        return texts.str[::-1]

    df = spark.createDataFrame([("B1", "x=abc;"), ("B2", "")], "asin string, html string")
    rules = [ExtractRule("x", "x=(.*?);", convert=backwards, default="none")]
    assert {r.asin: r.x for r in extract(df, rules, on_error="null").collect()} == {"B1": "cba", "B2": "none"}


def test_new_page_kind(spark):
    offers = PageKind(
        "offers", "https://example.com/offers/{}", "offers-{}.html", (ExtractRule("n", r"(\d+) offers", convert=to_int, default=0),), "offers"
    )
    kinds = (*PAGE_KINDS, offers)
    df = spark.createDataFrame([("B1", "offers", "12 offers"), ("B1", "info", "12 offers")], "asin string, page_kind string, html string")
    assert [tuple(r)[:2] for r in facts_of(extract_all(df, kinds), offers).collect()] == [("B1", 12)]
    named = df.select("asin", "page_kind", cache_file(F.col("asin"), F.col("page_kind"), kinds).alias("f"))
    back = named.select("page_kind", parse_cache_file(F.col("f"), kinds).alias("k"))
    assert all(r.page_kind == r.k.page_kind for r in back.collect())


def test_rule_needs_its_group():
    with pytest.raises(ValueError):
        ExtractRule("x", r"no groups")
    with pytest.raises(ValueError):
        ExtractRule("x", r"(one)", target_group=1)


def test_kinds_in_one_scan(spark):
    rows = [("B1", "info", "<title>T</title>"), ("B1", "reviews", "See all 3 positive reviews"),
            ("B2", "info", "See all 3 positive reviews"), ("B3", "info", None), ("B4", "other", "<title>T</title>")]
    df = spark.createDataFrame(rows, "asin string, page_kind string, html string")
    both = extract_all(df, (INFO, REVIEWS))
    plan = physical_plan(both)
    assert plan.count("ArrowEvalPython") == 1
    for kind in (INFO, REVIEWS):
        alone = extract_facts(df.where(F.col("page_kind") == kind.name), kind)
        assert sorted(map(str, facts_of(both, kind).collect())) == sorted(map(str, alone.collect()))
    assert facts_of(both, INFO).count() == 2


def test_listing(spark):
    df = spark.createDataFrame([("B1", "<title>Thing</title>")], "asin string, html string")
    lines = {r.field: r.line for r in fact_listing(extract_facts(df, INFO), INFO).collect()}
    assert lines["product_name"] == f" * {'product_name': <25}Thing"
    assert lines["average_rating"] == f" * {'average_rating': <25}None"
    assert lines["total_ratings"] == f" * {'total_ratings': <25}0"
    assert len(lines) == 4


def test_pages_go_to_python_once_and_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([("B1", "x")], "asin string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    plan = physical_plan(extract_facts(pages, INFO))
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan
    assert physical_plan(extract_all(pages.withColumn("page_kind", F.lit("info")), (INFO, REVIEWS))).count("FileScan") == 1
    only_keys = physical_plan(extract_facts(pages, INFO).select("asin"))
    assert "ArrowEvalPython" not in only_keys
