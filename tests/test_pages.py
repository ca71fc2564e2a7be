import re

import pytest
from conftest import physical_plan
from pyspark.sql import functions as F

from pagefacts.functions.rules import INFO, REVIEWS, cache_file, parse_cache_file, target_url
from pagefacts.operators.cache import PAGE_KEY, cache_hits, cache_misses, new_pages
from pagefacts.operators.extract import extract_all, extract_facts
from pagefacts.operators.membership import key_filter, may_be_listed, never_listed, only_listed
from pagefacts.plans.build import build_tables
from pagefacts.sources.page_buckets import add_to_buckets, pages_of, read_page_buckets
from pagefacts.sources.pages import read_page_files, read_page_table, write_new_pages
from pagefacts.streaming.pages import loaded_facts, page_table_stream, stream_facts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_file_names(spark):
    df = spark.createDataFrame(
        [("B1", "info"), ("B1", "reviews"), ("reviews-", "info"), ("B1", "other")], "asin string, page_kind string"
    )
    named = df.withColumn("f", cache_file(F.col("asin"), F.col("page_kind")))
    named = named.withColumn("u", target_url(F.col("asin"), F.col("page_kind")))
    got = {(r.asin, r.page_kind): (r.f, r.u) for r in named.collect()}
    assert got == {
        ("B1", "info"): ("B1.html", "https://www.amazon.com/dp/B1"),
        ("B1", "reviews"): ("reviews-B1.html", "https://www.amazon.com/product-reviews/B1"),
        ("reviews-", "info"): ("reviews-.html", "https://www.amazon.com/dp/reviews-"),
        ("B1", "other"): (None, None),
    }
    back = named.where("f is not null").select("asin", "page_kind", parse_cache_file(F.col("f")).alias("k"))
    for r in back.collect():
        assert (r.k.asin, r.k.page_kind) == (r.asin, r.page_kind)
    alien = spark.createDataFrame([("notes.txt",), (".html",)], "f string").select(parse_cache_file(F.col("f")).alias("k"))
    assert [r.k for r in alien.collect()] == [None, None]


def test_page_files(spark, tmp_path):
    folder = tmp_path / "cache"
    folder.mkdir()
    (folder / "B1.html").write_text("<p>\r\nä\r</p>\n", encoding="utf-8-sig", newline="")
    (folder / "reviews-B1.html").write_text("r", encoding="utf-8")
    (folder / "B 2+%20ü.html").write_text("odd name", encoding="utf-8")
    (folder / "empty.html").write_bytes(b"\xef\xbb\xbf")
    (folder / "notes.txt").write_text("no page")
    (folder / "reviews-B 3+%20ü.html").write_bytes(b"")
    (folder / "notes2.txt").write_bytes(b"")
    got = rows(read_page_files(spark, str(folder)))
    assert ("B1", "info", "<p>\nä\n</p>\n") in got
    assert ("B1", "reviews", "r") in got
    assert ("B 2+%20ü", "info", "odd name") in got
    assert ("empty", "info", "") in got
    assert ("B 3+%20ü", "reviews", "") in got
    assert len(got) == 5
    (facts,) = extract_facts(read_page_files(spark, str(folder)).where("asin = 'B 3+%20ü'"), REVIEWS).collect()
    assert (facts.total_reviews, facts.positive_reviews, facts.critical_reviews) == (0, 0, 0)


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "asin string, page_kind string, html string"
    write_new_pages(spark.createDataFrame([("B1", "info", "old"), ("B2", "info", "x")], schema), path)
    held = read_page_table(spark, path)
    asked = spark.createDataFrame([("B1", "info"), ("B1", "reviews"), ("B3", "info")], "asin string, page_kind string")
    assert rows(cache_hits(asked, held)) == [("B1", "info")]
    assert rows(cache_misses(asked, held)) == [("B1", "reviews"), ("B3", "info")]
    assert rows(cache_hits(asked, held, use_cache=False)) == []
    assert len(rows(cache_misses(asked, held, use_cache=False))) == 3
    new = spark.createDataFrame([("B1", "info", "new"), ("B1", "reviews", "r"), ("B1", "reviews", "r")], schema)
    write_new_pages(new, path, held)
    assert rows(read_page_table(spark, path)) == [("B1", "info", "old"), ("B1", "reviews", "r"), ("B2", "info", "x")]
    added = new_pages(spark.createDataFrame([("B1", "info", "x"), ("B7", "info", "y")], schema), held)
    assert rows(added.select("asin", "page_kind", "html")) == [("B7", "info", "y")]
    plan = physical_plan(read_page_table(spark, path).where("page_kind = 'info'"))
    assert "PartitionFilters: [isnotnull(page_kind" in plan


def test_only_new_pages_cross_a_shuffle(spark, tmp_path):
    """A nearly full cache: the filter on the few new keys selects the pages, whatever Spark's own limit for broadcasts."""
    path, limit = str(tmp_path / "pages"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    schema = "asin string, page_kind string, html string"
    spark.createDataFrame([(f"B{i}", "info", f"page {i}") for i in range(50)], schema).write.parquet(path)
    found = spark.read.parquet(path)
    held = found.where("asin <> 'B7'").select("asin", "page_kind")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        added = new_pages(found, held)
        once, several = physical_plan(added).split("SortAggregate", 1)
        # In both, what is shuffled stands above the join with the filter.
        assert once.index("hashpartitioning(asin") < once.index("BroadcastHashJoin")
        facts = physical_plan(only_listed(extract_facts(may_be_listed(found, key_filter(held, ["asin"]), ["asin"]), INFO), held, ["asin"]))
        # From the bottom: the filter, the decoder, a shuffle of facts.
        assert facts.index("hashpartitioning(asin") < facts.index("ArrowEvalPython") < facts.index("BroadcastHashJoin")
        assert several.index("hashpartitioning(asin") < several.index("BroadcastHashJoin")
        assert rows(may_be_listed(found, key_filter(found.where("asin = 'B7'"), PAGE_KEY), PAGE_KEY)) == [("B7", "info", "page 7")]
        assert rows(added) == [("B7", "info", "page 7")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    twice = spark.createDataFrame([("B1", "info", "b", 2), ("B1", "info", "a", 3)], f"{schema}, seq int")
    assert rows(new_pages(twice)) == [("B1", "info", "a")]
    assert rows(new_pages(twice, first_by=F.col("seq"))) == [("B1", "info", "b")]


def test_pages_of_a_new_cache_are_not_joined(spark):
    """Only pages whose key may occur more than once meet the list of these keys; rows without a whole key stay out."""
    schema = "asin string, page_kind string, html string"
    once = [(f"B{i}", kind, f"page {i}") for i in range(200) for kind in ("info", "reviews")]
    several = [("C1", "info", "b"), ("C1", "info", "a"), ("C2", "info", None), ("C2", "info", "x"), ("C2", "info", "x")]
    found = spark.createDataFrame(once + several + [(None, "info", "y"), ("B1", None, "z"), ("D1", "info", None)], schema)
    added = new_pages(found)
    assert rows(added) == rows(spark.createDataFrame([*once, ("C1", "info", "a"), ("C2", "info", None), ("D1", "info", None)], schema))
    listed = key_filter(found.where("asin LIKE 'C%'"), PAGE_KEY)
    never = never_listed(found, listed, PAGE_KEY)
    assert never.count() + may_be_listed(found, listed, PAGE_KEY).count() == found.count()
    assert never.where("asin LIKE 'C%'").count() == 0 < never.count()


def test_key_filter(spark):
    """Every listed key passes, hardly any other, and the plan does not depend on the length of the list."""
    keys = spark.range(300_000).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("asin"), F.lit("info").alias("page_kind"))
    rows, plans = keys.where("asin >= 'B2'").withColumn("html", F.lit("x")), set()
    for n, share in ((10, 0), (20_000, 0.001), (120_000, 0.001)):
        listed = keys.limit(n)
        passed = may_be_listed(rows, key_filter(listed, PAGE_KEY), PAGE_KEY)
        assert passed.columns == rows.columns
        wanted = rows.join(listed, PAGE_KEY, "left_semi").count()
        assert passed.join(listed, PAGE_KEY, "left_semi").count() == wanted
        assert passed.count() - wanted <= share * rows.count()
        plans.add(re.sub(r"#\d+L?|key-filter-\w+|plan_id=\d+|Location.*?\]", "", physical_plan(passed)))
    assert len(plans) == 1
    none = may_be_listed(rows, key_filter(keys.where("false"), PAGE_KEY), PAGE_KEY)
    assert none.count() == 0
    # A full filter lets everything pass, and loses nothing.
    assert may_be_listed(rows, key_filter(keys, PAGE_KEY, blocks=1), PAGE_KEY, blocks=1).count() == rows.count()


def test_pages_that_no_list_asks_for_are_not_decoded(spark, tmp_path):
    """Counted where the pages go to Python, in a batch and in a stream."""
    schema, ids = "asin string, page_kind string, html string", listed_ids(spark)
    pages = spark.createDataFrame([(f"B{i}", "info", f"<title>{i}</title>") for i in range(2000)], schema)
    seen = []

    def counted(df, kinds, **options):
        seen.append(df.count())
        return extract_all(df, kinds, **options)

    patch = pytest.MonkeyPatch()
    patch.setattr("pagefacts.plans.build.extract_all", counted)
    patch.setattr("pagefacts.streaming.pages.extract_all", counted)
    try:
        built = build_tables(spark, ids, pages, str(tmp_path / "db"))
        assert built.product_info.count() == 50
        pages.write.parquet(str(tmp_path / "in"))
        source = page_table_stream(spark, str(tmp_path / "in"))
        stream_facts(source, ids, str(tmp_path / "sdb"), str(tmp_path / "cp"), on_unknown="drop").awaitTermination()
    finally:
        patch.undo()
    assert loaded_facts(spark, str(tmp_path / "sdb"), INFO).count() == 50
    assert len(seen) == 2 and all(50 <= n <= 52 for n in seen)


def listed_ids(spark):
    return spark.createDataFrame([(f"B{i}",) for i in range(50)], "asin string")


@pytest.mark.parametrize("partitions", ["4", "50"])
def test_no_bucketed_page_is_shuffled(spark, tmp_path, partitions):
    """With few and with many partitions, and no broadcast."""
    path, settings = str(tmp_path / "it's a cache"), {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": partitions}
    old = {key: spark.conf.get(key) for key in settings}
    pages = spark.createDataFrame(
        [(f"B{i % 90}", "info" if i < 90 else "reviews", f"page {i}") for i in range(180)], "asin string, page_kind string, html string"
    )
    with pytest.raises(ValueError, match="no page buckets"):
        read_page_buckets(spark, path)
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        add_to_buckets(pages.where("asin < 'B5'"), path, buckets=8)
        add_to_buckets(pages.union(pages), path, buckets=99)
        assert rows(read_page_buckets(spark, path)) == rows(pages)
        keys = pages.where("html like '%3'").select("asin", "page_kind").unionByName(pages.limit(1).select("asin", "page_kind"))
        found = pages_of(spark, path, keys)
        above_scan = [line for line in physical_plan(found).split("FileScan")[0].splitlines() if "Exchange" in line]
        assert not above_scan and "Bucketed: true" in physical_plan(found)
        assert rows(found) == rows(pages.where("html like '%3' or html = 'page 0'"))
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
