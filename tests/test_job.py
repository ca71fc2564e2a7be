import pytest

from pagefacts.fixed_values import DEFAULT_IDENTIFIERS
from pagefacts.plans.job import arguments, run
from pagefacts.sources.tables import read_table


def test_arguments():
    with pytest.raises(SystemExit):
        arguments([])
    with pytest.raises(SystemExit):
        arguments(["-i"])
    with pytest.raises(SystemExit):
        arguments(["ids.csv"])
    assert arguments(["--pages", "b", "--tables", "c"]).identifiers == DEFAULT_IDENTIFIERS
    assert arguments(["-i", "a", "--pages", "b", "--tables", "c"]).pages_as == "table"


def test_job(spark, tmp_path):
    pages = tmp_path / "cache"
    pages.mkdir()
    (pages / "B1.html").write_text("<title>Amazon.com: One</title>", encoding="utf-8-sig")
    (pages / "reviews-B2.html").write_text("Showing 1-10 of 12 reviews", encoding="utf-8-sig")
    (tmp_path / "ids.csv").write_text("B2\nB1\nB3\n")
    words = ["-i", str(tmp_path / "ids.csv"), "--pages", str(pages), "--pages-as", "files", "--tables", str(tmp_path / "db")]
    run(spark, arguments([*words, "--reports", str(tmp_path / "reports")]))
    tables = str(tmp_path / "db")
    assert sorted(r.asin for r in read_table(spark, tables, "asins").collect()) == ["B1", "B2", "B3"]
    assert [(r.asin, r.product_name) for r in read_table(spark, tables, "product_info").collect()] == [("B1", "One")]
    assert [(r.asin, r.total_reviews) for r in read_table(spark, tables, "product_reviews").collect()] == [("B2", 12)]
    lines = [r.value for r in spark.read.text(str(tmp_path / "reports" / "product_info")).collect()]
    assert len(lines) == 3 and "One" in lines[2]
    with pytest.raises(ValueError, match="Asins sample.csv does not exist"):
        run(spark, arguments(words[2:]))
    with pytest.raises(ValueError, match="does not exist"):
        run(spark, arguments(["-i", str(tmp_path / "no.csv"), *words[2:]]))
