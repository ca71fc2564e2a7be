import datetime

import pytest
from conftest import physical_plan
from pyspark.sql import functions as F

from pagefacts import schema
from pagefacts.functions.rules import INFO, REVIEWS
from pagefacts.operators.extract import extract_facts
from pagefacts.operators.integrity import fk_violations, pk_violations, product_360
from pagefacts.operators.membership import key_filter, may_be_listed
from pagefacts.plans import manifest
from pagefacts.plans.build import build_tables, cache_from_log, facts_from_log, write_reports
from pagefacts.schema import FETCH_LOG, PAGE_SNAPSHOT
from pagefacts.sources import tables
from pagefacts.sources.pages import read_page_table

WHEN = datetime.datetime(2024, 1, 2, 3, 4, 5)


def stamp():
    return F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "asin string")


def info_facts(spark, *names):
    pages = [(n, "info", f"<title>Thing {n}</title>") for n in names]
    return extract_facts(spark.createDataFrame(pages, PAGE_SNAPSHOT), INFO)


def test_load(spark, tmp_path):
    root = str(tmp_path)
    tables.create_tables(spark, root)
    for name, columns in schema.TABLES.items():
        empty = tables.read_table(spark, root, name)
        assert empty.count() == 0
        assert [f.dataType for f in empty.schema] == [f.dataType for f in columns]
    tables.load_ids(ids(spark, "B1", "B2", "B3"), root, stamp())
    tables.load_facts(info_facts(spark, "B3", "B1"), root, INFO, recorded_at=stamp())
    tables.load_facts(info_facts(spark, "B2"), root, INFO, recorded_at=stamp())
    rows = [tuple(r) for r in tables.scan_table(spark, root, "product_info").collect()]
    assert rows == [
        (1, WHEN, "B1", "Thing B1", 0, None, 0),
        (2, WHEN, "B3", "Thing B3", 0, None, 0),
        (3, WHEN, "B2", "Thing B2", 0, None, 0),
    ]
    tables.check_primary_keys(spark, root)
    tables.create_tables(spark, root)
    assert tables.scan_table(spark, root, "product_info").count() == 0


def test_load_time_is_one_value(spark, tmp_path):
    root = str(tmp_path)
    tables.create_tables(spark, root)
    tables.load_ids(ids(spark, "B1", "B2", "B3").repartition(3), root)
    times = {r.recorded_at for r in tables.read_table(spark, root, "asins").collect()}
    assert len(times) == 1 and times.pop() is not None


def test_unknown_identifiers(spark, tmp_path):
    root = str(tmp_path)
    tables.create_tables(spark, root)
    tables.load_ids(ids(spark, "B1"), root)
    facts = info_facts(spark, "B1", "B9")
    with pytest.raises(ValueError, match="B9"):
        tables.load_facts(facts, root, INFO)
    assert tables.read_table(spark, root, "product_info").count() == 0
    tables.load_facts(facts, root, INFO, on_unknown="drop")
    assert [r.asin for r in tables.read_table(spark, root, "product_info").collect()] == ["B1"]
    with pytest.raises(ValueError):
        tables.load_facts(facts, root, INFO, on_unknown="guess")
    orphans = info_facts(spark, "B1", "B9", "B9", "B8")
    got = sorted(tuple(r) for r in fk_violations(orphans, ids(spark, "B1")).collect())
    assert got == [("B8", 1), ("B9", 2)]


def test_primary_keys(spark, tmp_path):
    assert [tuple(r) for r in pk_violations(ids(spark, "B1", "B2", "B1"), "asin").collect()] == [("B1", 2)]
    root = str(tmp_path)
    tables.create_tables(spark, root)
    with pytest.raises(ValueError, match="B1"):
        tables.load_ids(ids(spark, "B1", "B1"), root)
    tables.load_ids(ids(spark, "B1", "B2"), root)
    with pytest.raises(ValueError, match="B2"):
        tables.load_ids(ids(spark, "B3", "B2"), root)
    assert sorted(r.asin for r in tables.read_table(spark, root, "asins").collect()) == ["B1", "B2"]
    tables.check_primary_keys(spark, root)
    held = manifest.entries(spark, root)
    again = tables.write_ids(ids(spark, "B1"), root, manifest.Entry(), stamp())
    manifest.publish(spark, root, held | {"asins": held["asins"].plus(again.folders[0], 1)})
    with pytest.raises(ValueError, match="B1"):
        tables.check_primary_keys(spark, root)


def test_repeated_pages_end_the_job(spark, tmp_path):
    page = ("B1", "info", "<title>Amazon.com: One</title>")
    pages = spark.createDataFrame([page, page], "asin string, page_kind string, html string")
    with pytest.raises(ValueError, match="B1 info"):
        build_tables(spark, ids(spark, "B1"), pages, str(tmp_path))


def test_unlisted_pages_do_not_reach_the_decoder(spark, tmp_path):
    """Whatever Spark's own limit for broadcasts, no page is shuffled and the join comes before the decoding."""
    path = str(tmp_path / "cache")
    rows = [("B1", "info", "<title>Amazon.com: One</title>"), ("B2", "info", "x")]
    spark.createDataFrame(rows, "asin string, page_kind string, html string").write.parquet(path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = may_be_listed(spark.read.parquet(path), key_filter(ids(spark, "B1"), ["asin"]), ["asin"])
        plan = physical_plan(extract_facts(wanted, INFO))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.index("ArrowEvalPython") < plan.index("BroadcastHashJoin") and "hashpartitioning" not in plan


def test_product_360_takes_the_last_load(spark):
    info = spark.createDataFrame([(1, "B1", "old", 1), (2, "B1", "new", 2), (3, "B2", "x", 3)], "id int, asin string, product_name string, total_ratings int")
    reviews = spark.createDataFrame([(1, "B1", 5), (2, "B1", 6), (3, "B3", 7)], "id int, asin string, total_reviews int")
    got = product_360(ids(spark, "B1", "B2", "B3", "B4"), info, reviews)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == [
        ("B1", "new", 2, 6), ("B2", "x", 3, None), ("B3", None, None, 7), ("B4", None, None, None),
    ]


def test_whole_job(spark, tmp_path):
    pages = spark.createDataFrame(
        [
            ("B1", "info", "<title>Amazon.com: One</title>"),
            ("B2", "info", '<span id="acrCustomerReviewText" class="a-size-base">many ratings</span>'),
            ("B9", "info", "<title>not asked for</title>"),
            ("B2", "reviews", "Showing 1-10 of 1,863 reviews"),
        ],
        PAGE_SNAPSHOT,
    )
    built = build_tables(spark, ids(spark, "B1", "B2", "B3"), pages, str(tmp_path / "db"), recorded_at=stamp())
    assert sorted(r.asin for r in built.asins.collect()) == ["B1", "B2", "B3"]
    info = {r.asin: (r.id, r.product_name, r.total_ratings) for r in built.product_info.collect()}
    assert info == {"B1": (1, "One", 0), "B2": (2, None, None)}
    reviews = [(r.id, r.asin, r.total_reviews, r.positive_reviews) for r in built.product_reviews.collect()]
    assert reviews == [(1, "B2", 1863, 0)]
    assert [tuple(r) for r in built.extract_errors.collect()] == [("B2", "info", "total_ratings", "many")]
    write_reports(spark, built.root, str(tmp_path / "reports"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "reports" / "asins")).collect()]
    assert lines[0].split(" │ ")[0] == "asin" and len(lines) == 5


def test_facts_come_from_the_settling_attempt(spark):
    title = "<title>{}</title>"
    log = spark.createDataFrame(
        [
            ("r", "info", "B1", 1, 502, None),
            ("r", "info", "B1", 2, 200, title.format("second\r try")),
            ("r", "info", "B1", 3, 200, title.format("too late")),
            ("r", "info", "B2", 4, 404, title.format("not found")),
            ("r", "info", "B2", 5, 200, title.format("after the end")),
            ("r", "reviews", "B1", 6, 200, "Showing 1-10 of 3 reviews"),
            ("s", "info", "B2", 7, 200, title.format("other run")),
        ],
        FETCH_LOG,
    )
    got = facts_from_log(log, INFO).collect()
    assert sorted((r.run_id, r.asin, r.iteration, r.product_name) for r in got) == [
        ("r", "B1", 2, None), ("s", "B2", 1, "other run"),
    ]
    assert [r.total_reviews for r in facts_from_log(log, REVIEWS).collect()] == [3]


def test_cache_from_log(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [
        ("r", "info", "B1", 1, 200, "first\r\n"), ("r", "info", "B1", 2, 200, "after the end"),
        ("r", "info", "B2", 3, 404, "not found"), ("r", "info", "B2", 4, 200, "after the end"),
        ("r", "info", "B3", 5, 502, None), ("r", "info", "B3", 6, 200, "third"),
        ("r", "reviews", "B3", 7, 200, "reviews"),
    ]
    log = spark.createDataFrame(rows, FETCH_LOG)
    cache_from_log(log, path)
    held = read_page_table(spark, path)
    pages = [("B1", "info", "first\n"), ("B3", "info", "third"), ("B3", "reviews", "reviews")]
    assert sorted(tuple(r) for r in held.collect()) == pages
    more = spark.createDataFrame([("s", "info", "B3", 1, 200, "newer"), ("s", "info", "B4", 2, 200, "fourth")], FETCH_LOG)
    cache_from_log(more, path, held)
    pages.insert(2, ("B4", "info", "fourth"))
    assert sorted(tuple(r) for r in read_page_table(spark, path).collect()) == sorted(pages)


def test_jdbc_options():
    options = tables.jdbc_options(
        dialect="postgresql", host="db.example.com", port=5432, database="shop", user=" me ", password=" pw\n", driver="org.postgresql.Driver"
    )
    assert options == {
        "url": "jdbc:postgresql://db.example.com:5432/shop", "user": "me", "password": "pw", "driver": "org.postgresql.Driver",
    }
    assert "driver" not in tables.jdbc_options(dialect="mysql", host="h", port="1", database="d", user="u", password="p")


def test_a_build_that_fails_leaves_the_tables(spark, tmp_path):
    root, page = str(tmp_path), ("B1", "info", "<title>Amazon.com: One</title>")
    pages = spark.createDataFrame([page], PAGE_SNAPSHOT)
    built = build_tables(spark, ids(spark, "B1"), pages, root)
    assert [r.product_name for r in built.product_info.collect()] == ["One"]
    for broken_ids, broken_pages in ((ids(spark, "B2", "B2"), pages), (ids(spark, "B1", "B2"), pages.union(pages))):
        with pytest.raises(ValueError):
            build_tables(spark, broken_ids, broken_pages, root)
        assert [r.asin for r in tables.read_table(spark, root, "asins").collect()] == ["B1"]
        assert [r.product_name for r in tables.read_table(spark, root, "product_info").collect()] == ["One"]
    slow = tables.read_table(spark, root, "product_info")
    build_tables(spark, ids(spark, "B3"), pages, root)
    assert [r.product_name for r in slow.collect()] == ["One"]
    assert tables.read_table(spark, root, "product_info").count() == 0
    manifest.empty_old_versions(spark, root)
    assert [r.asin for r in tables.read_table(spark, root, "asins").collect()] == ["B3"]
    assert sum(f.stat().st_size > 1500 for f in (tmp_path / "product_info").glob("*/*.parquet")) == 0


def test_no_load_reads_earlier_facts(spark, tmp_path):
    root = str(tmp_path)
    tables.create_tables(spark, root)
    tables.load_ids(ids(spark, "B1", "B2", "B3"), root)
    tables.load_facts(info_facts(spark, "B1", "B2"), root, INFO)
    held = manifest.entries(spark, root)["product_info"]
    assert (held.n_rows, held.last_id, len(held.folders)) == (2, 2, 1)
    (tmp_path / held.folders[0]).rename(tmp_path / "away")
    tables.load_facts(info_facts(spark, "B3"), root, INFO)
    (tmp_path / "away").rename(tmp_path / held.folders[0])
    got = sorted((r.id, r.asin) for r in tables.read_table(spark, root, "product_info").collect())
    assert got == [(1, "B1"), (2, "B2"), (3, "B3")]


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert manifest.current_version(spark, root) == -1 and manifest.entries(spark, root) == {}
    with pytest.raises(ValueError, match="no table asins"):
        tables.read_table(spark, root, "asins")
    tables.create_tables(spark, root)
    # A manifest that is still being written is no version.
    (tmp_path / "manifest" / "version=1" / "_temporary").mkdir(parents=True)
    assert manifest.current_version(spark, root) == 0
