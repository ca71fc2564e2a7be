
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_crawl import FINAL, make_log, random_attempts, retell

from pagefacts.fixed_values import ROBOT_CHECK
from pagefacts.functions.rules import INFO, REVIEWS
from pagefacts.operators.extract import extract_facts
from pagefacts.plans.build import build_tables
from pagefacts.schema import FETCH_LOG, PAGE_SNAPSHOT
from pagefacts.sources.pages import write_new_pages
from pagefacts.streaming import outcomes as outcome_stream
from pagefacts.streaming import pages as page_stream
from pagefacts.streaming.outcomes import close_runs, outcomes, stream_outcomes
from pagefacts.streaming.pages import loaded_facts, page_file_stream, page_table_stream, stream_facts


def pages(spark, names):
    rows = [(n, "info", f"<title>{n}</title>") for n in names]
    rows += [(n, "reviews", f"See all {i} positive reviews") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, PAGE_SNAPSHOT)


def listed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "asin string")


def test_facts_arrive_once(spark, tmp_path):
    arriving, root, checkpoint = (str(tmp_path / n) for n in ("in", "db", "cp"))
    first, second = pages(spark, ["B1", "B2"]), pages(spark, ["B3"])

    def run():
        stream_facts(page_table_stream(spark, arriving), listed(spark, "B1", "B2", "B3"), root, checkpoint).awaitTermination()
        return sorted((r.id, r.asin, r.product_name) for r in loaded_facts(spark, root, INFO).collect())

    first.write.mode("append").parquet(arriving)
    assert run() == [(1, "B1", "B1"), (2, "B2", "B2")]
    assert run() == [(1, "B1", "B1"), (2, "B2", "B2")]
    second.write.mode("append").parquet(arriving)
    assert run() == [(1, "B1", "B1"), (2, "B2", "B2"), (3, "B3", "B3")]
    batch = extract_facts(first.union(second).where("page_kind = 'reviews'"), REVIEWS)
    assert sorted((r.asin, r.positive_reviews) for r in loaded_facts(spark, root, REVIEWS).collect()) == sorted(
        (r.asin, r.positive_reviews) for r in batch.collect()
    )


def test_the_page_cache_is_a_source(spark, tmp_path):
    path, root = str(tmp_path / "cache"), str(tmp_path / "db")
    write_new_pages(pages(spark, ["B1", "B2"]), path)
    stream_facts(page_table_stream(spark, path), listed(spark, "B1", "B2"), root, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.id, r.product_name) for r in loaded_facts(spark, root, INFO).collect()) == [(1, "B1"), (2, "B2")]
    got = sorted((r.asin, r.positive_reviews) for r in loaded_facts(spark, root, REVIEWS).collect())
    assert got == [("B1", 0), ("B2", 1)]


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    """As after a failure between writing the tables and marking the batch done."""
    arriving, root, checkpoint = (str(tmp_path / n) for n in ("in", "db", "cp"))

    def run():
        stream_facts(page_table_stream(spark, arriving), listed(spark, "B1", "B2", "B3"), root, checkpoint).awaitTermination()
        return sorted((r.id, r.asin) for r in loaded_facts(spark, root, INFO).collect())

    pages(spark, ["B1", "B2"]).write.mode("append").parquet(arriving)
    run()
    pages(spark, ["B3"]).write.mode("append").parquet(arriving)
    before = run()
    for mark in (tmp_path / "cp" / "commits").glob("*1*"):
        mark.unlink()
    assert run() == before == [(1, "B1"), (2, "B2"), (3, "B3")]
    assert spark.read.parquet(f"{root}/product_info").where("batch_id = 1").count() == 1


def test_page_files_and_errors(spark, tmp_path):
    arriving, root = tmp_path / "in", str(tmp_path / "db")
    arriving.mkdir()
    (arriving / "B1.html").write_text("<title>one</title>", encoding="utf-8-sig")
    (arriving / "reviews-B1.html").write_text("See all of 3 positive reviews", encoding="utf-8")
    stream_facts(page_file_stream(spark, str(arriving)), listed(spark, "B1"), root, str(tmp_path / "cp")).awaitTermination()
    assert [r.product_name for r in loaded_facts(spark, root, INFO).collect()] == ["one"]
    errors = spark.read.parquet(f"{root}/extract_errors").collect()
    assert [(r.asin, r.page_kind, r.field, r.raw) for r in errors] == [("B1", "reviews", "positive_reviews", "of 3")]


@pytest.mark.parametrize("hot,limit,on_request_error", [(False, 20, "lost"), (True, 5, "lost"), (True, 6, "retry")])
def test_outcomes_over_batches(spark, tmp_path, hot, limit, on_request_error):
    attempts = random_attempts(17, hot=hot)
    final = FINAL if on_request_error == "lost" else FINAL - {"lost"}
    _, expected, _ = retell(attempts, limit, final)
    arriving = str(tmp_path / "in")
    log = make_log(spark, attempts)
    for low, high in ((0, 100), (100, 250), (250, 400)):
        part = log.where((F.col("seq") >= low) & (F.col("seq") < high))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(arriving)
    source = spark.readStream.schema(FETCH_LOG).option("maxFilesPerTrigger", 1).parquet(arriving)
    root = str(tmp_path / "out")
    query = stream_outcomes(
        source, root, str(tmp_path / "cp"), max_iterations=limit, on_request_error=on_request_error
    )
    query.awaitTermination()
    assert sum(p.numInputRows > 0 for p in query.recentProgress) == 3

    def found():
        got = [((r.run_id, r.asin), (r.outcome, r.attempts)) for r in outcomes(spark, root).collect()]
        assert len(got) == len(dict(got))
        return dict(got)

    settled = {k: v for k, v in expected.items() if v[0] != "unscraped" or v[1] >= limit}
    assert found() == settled
    runs = sorted({run for run, _ in expected})
    close_runs(spark, root, spark.createDataFrame([(runs[0],)], "run_id string"))
    assert found() == settled | {k: v for k, v in expected.items() if k[0] == runs[0]}
    close_runs(spark, root)
    close_runs(spark, root)
    assert found() == expected


def test_an_outcome_batch_run_again_adds_nothing(spark, tmp_path):
    attempts = random_attempts(3)
    arriving, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    log = make_log(spark, attempts)

    def run():
        source = spark.readStream.schema(FETCH_LOG).parquet(arriving)
        stream_outcomes(source, root, checkpoint).awaitTermination()
        return sorted(map(tuple, outcomes(spark, root).collect()))

    for low, high in ((0, 120), (120, 400)):
        log.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(arriving)
        before = run()
    for mark in (tmp_path / "cp" / "commits").glob("*1*"):
        mark.unlink()
    assert run() == before


def test_stream_checks_the_parent_and_validates_like_the_batch(spark, tmp_path):
    robots = f"<title>x</title>{ROBOT_CHECK}"
    rows = [("B1", "info", "<title>one</title>"), ("B2", "info", robots), ("B9", "info", "<title>nine</title>")]
    source = str(tmp_path / "in")
    pages = spark.createDataFrame(rows, PAGE_SNAPSHOT)
    pages.write.parquet(source)
    ids = listed(spark, "B1", "B2")
    with pytest.raises(StreamingQueryException, match="B9"):
        stream_facts(page_table_stream(spark, source), ids, str(tmp_path / "a"), str(tmp_path / "ca")).awaitTermination()
    for validate, expected in ((False, ["B1", "B2"]), (True, ["B1"])):
        root = str(tmp_path / f"db{validate}")
        stream_facts(
            page_table_stream(spark, source), ids, root, f"{root}-cp", on_unknown="drop", validate=validate
        ).awaitTermination()
        assert sorted(r.asin for r in loaded_facts(spark, root, INFO).collect()) == expected
        built = build_tables(spark, ids, pages, f"{root}-batch", validate=validate)
        assert sorted(r.asin for r in built.product_info.collect()) == expected


def test_a_last_batch_that_settles_all(spark, tmp_path):
    """It writes no open row; those of the batch before must not be taken for open ones."""
    arriving, root = str(tmp_path / "in"), str(tmp_path / "out")
    for attempts in ([("r0", "B1", 1, "retry"), ("r0", "B2", 2, "retry")], [("r0", "B1", 3, "ok"), ("r0", "B2", 4, "ok")]):
        make_log(spark, attempts).coalesce(1).write.mode("append").parquet(arriving)
        source = spark.readStream.schema(FETCH_LOG).parquet(arriving)
        stream_outcomes(source, root, str(tmp_path / "cp")).awaitTermination()
    close_runs(spark, root)
    got = sorted((r.asin, r.outcome, r.attempts) for r in outcomes(spark, root).collect())
    assert got == [("B1", "ok", 2), ("B2", "ok", 2)]


def arrive(spark, attempts, arriving, root, checkpoint):
    """One micro-batch, or none."""
    if attempts:
        make_log(spark, attempts).coalesce(1).write.mode("append").parquet(arriving)
    source = spark.readStream.schema(FETCH_LOG).parquet(arriving)
    query = stream_outcomes(source, root, checkpoint)
    query.awaitTermination()
    return query


def test_a_batch_reads_the_state_of_its_own_runs(spark, tmp_path, monkeypatch):
    """Thirty batches of new runs, one old run in all of them: the state that is read stays the same."""
    arriving, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    read, sizes = outcome_stream._read, []

    def spied(spark, root, name, runs=None):
        rows = read(spark, root, name, runs)
        files = [f for f in rows.inputFiles() if "run=none" not in f]
        assert all(any(f"run={run}" in f for run in runs) for f in files)
        sizes.append((rows.count(), len(files)))
        return rows

    for batch in range(30):
        name = f"r{batch}/ =é"
        attempts = [(name, "B1", 10 * batch, "ok"), (name, "B2", 10 * batch + 1, "retry")]
        attempts += [("old", "B7", 10 * batch + 2, "retry")] if batch < 15 else []
        make_log(spark, attempts).coalesce(1).write.mode("append").parquet(arriving)
    source = spark.readStream.schema(FETCH_LOG).option("maxFilesPerTrigger", 1).parquet(arriving)
    monkeypatch.setattr(outcome_stream, "_read", spied)
    stream_outcomes(source, root, checkpoint).awaitTermination()
    monkeypatch.undo()
    late = sizes[-3 * 14 :]
    assert len(sizes) == 90 and set(late) == {(0, 0)}
    assert max(n for _, n in sizes) <= 4
    close_runs(spark, root)
    got = sorted((r.run_id, r.asin, r.outcome, r.attempts) for r in outcomes(spark, root).collect())
    expected = [(f"r{b}/ =é", *end) for b in range(30) for end in (("B1", "ok", 1), ("B2", "unscraped", 1))]
    assert got == sorted([*expected, ("old", "B7", "unscraped", 15)])


def test_closing_that_stops_half_way(spark, tmp_path, monkeypatch):
    """Unscraped rows are written, the runs are not marked: closing again gives every identifier once."""
    where = [str(tmp_path / n) for n in ("in", "out", "cp")]
    root, mark = where[1], outcome_stream._mark_closed

    def stops(over, root):
        raise RuntimeError("stopped")

    def found():
        return sorted((r.run_id, r.asin, r.outcome, r.attempts) for r in outcomes(spark, root).collect())

    arrive(spark, [("r0", "B1", 1, "retry"), ("r0", "B2", 2, "ok"), ("r1", "B1", 3, "retry")], *where)
    monkeypatch.setattr(outcome_stream, "_mark_closed", stops)
    with pytest.raises(RuntimeError):
        close_runs(spark, root)
    assert found() == [("r0", "B2", "ok", 1)]
    # The stream goes on, and settles what had been written as unscraped.
    arrive(spark, [("r0", "B1", 4, "ok"), ("r0", "B3", 5, "retry")], *where)
    with pytest.raises(RuntimeError):
        close_runs(spark, root)
    # One of the runs is marked before the next stop.
    monkeypatch.setattr(outcome_stream, "_mark_closed", lambda over, root: mark(over.where("run_id = 'r0'"), root))
    close_runs(spark, root)
    r0 = [("r0", "B1", "ok", 2), ("r0", "B2", "ok", 1), ("r0", "B3", "unscraped", 1)]
    assert found() == r0
    monkeypatch.setattr(outcome_stream, "_mark_closed", mark)
    close_runs(spark, root)
    close_runs(spark, root)
    assert found() == [*r0, ("r1", "B1", "unscraped", 1)]
    # Attempts of a closed run change nothing.
    arrive(spark, [("r0", "B3", 6, "ok"), ("r2", "B1", 7, "ok")], *where)
    assert found() == [*r0, ("r1", "B1", "unscraped", 1), ("r2", "B1", "ok", 1)]


def test_a_batch_without_commit_is_not_there(spark, tmp_path, monkeypatch):
    """A micro-batch stops after writing its outcomes; its run is closed; the batch runs again."""
    where = [str(tmp_path / n) for n in ("in", "out", "cp")]
    root, commit = where[1], outcome_stream._commit

    def stops(spark, root, batch_id, *rest, **mode):
        if batch_id == 1:
            raise RuntimeError("stopped")
        commit(spark, root, batch_id, *rest, **mode)

    def found():
        return sorted((r.run_id, r.asin, r.outcome, r.attempts) for r in outcomes(spark, root).collect())

    arrive(spark, [("r0", "B1", 1, "retry"), ("r1", "B1", 2, "retry")], *where)
    monkeypatch.setattr(outcome_stream, "_commit", stops)
    with pytest.raises(StreamingQueryException):
        arrive(spark, [("r0", "B1", 3, "ok"), ("r1", "B1", 4, "ok")], *where)
    monkeypatch.undo()
    assert found() == []
    close_runs(spark, root, spark.createDataFrame([("r0",)], "run_id string"))
    assert found() == [("r0", "B1", "unscraped", 1)]
    arrive(spark, [], *where)
    assert found() == [("r0", "B1", "unscraped", 1), ("r1", "B1", "ok", 2)]


def test_a_page_that_comes_again_ends_the_stream(spark, tmp_path, monkeypatch):
    """In one batch or in several, as in a batch job; only batches that overlap are looked at."""
    arriving, root, checkpoint = (str(tmp_path / n) for n in ("in", "db", "cp"))
    ids = listed(spark, *(f"B{i}" for i in range(10)))
    looked = []
    found_before = page_stream._loaded_before

    def spied(*args):
        rows = found_before(*args)
        looked.append(len({f.split("batch_id=")[1].split("/")[0] for f in rows.inputFiles() if "/product_info/batch_id=" in f}))
        return rows

    monkeypatch.setattr(page_stream, "_loaded_before", spied)

    def run(*names, again=None):
        page_rows = pages(spark, names)
        (page_rows if again is None else page_rows.union(page_rows)).coalesce(1).write.mode("append").parquet(arriving)
        stream_facts(page_table_stream(spark, arriving), ids, root, checkpoint).awaitTermination()

    run("B1", "B2")
    run("B3", "B4")
    run("B5")
    assert looked == [0] * 6
    with pytest.raises(StreamingQueryException, match="page 'B4 info' was loaded before"):
        run("B4", "B6")
    assert looked[6] == 2
    assert sorted((r.id, r.asin) for r in loaded_facts(spark, root, INFO).collect()) == [(i, f"B{i}") for i in range(1, 6)]
    arriving, root, checkpoint = (str(tmp_path / n) for n in ("in2", "db2", "cp2"))
    with pytest.raises(StreamingQueryException, match="page 'B7 (info|reviews)' occurs 2 times"):
        run("B7", again=True)
