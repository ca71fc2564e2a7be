"""Crawl results against a plain retelling of the crawl, run by run."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import physical_plan
from pyspark.sql import functions as F

from pagefacts.fixed_values import KEY_MISSING, QUOTA_USED_UP, ROBOT_CHECK
from pagefacts.operators import crawl
from pagefacts.schema import FETCH_LOG
from pagefacts.sources.fetch_log import read_fetch_log

FINAL = {"ok", "invalid", "lost"}


def make_log(spark, attempts):
    """attempts: (run, asin, seq, class)"""
    reply = {"ok": (200, "<p>"), "retry": (502, None), "invalid": (404, "gone"), "lost": (None, None)}
    return spark.createDataFrame([(r, "info", a, s, *reply[c]) for r, a, s, c in attempts], FETCH_LOG)


def random_attempts(seed, runs=3, ids=12, count=400, hot=False):
    rng = random.Random(seed)
    result = []
    for seq in range(count):
        run = "r0" if hot and rng.random() < 0.8 else f"r{rng.randrange(runs)}"
        asin = "HOT" if hot and rng.random() < 0.4 else f"B{rng.randrange(ids)}"
        cls = rng.choices(["ok", "retry", "invalid", "lost"], [2, 8, 1, 1])[0]
        if asin == "HOT" and run == "r0":
            cls = "retry"
        result.append((run, asin, seq, cls))
    return result


def retell(attempts, limit=20, final=FINAL, initial=0, delta=10):
    """(effective rows, outcomes, waits) by going through each run in order."""
    effective, outcomes, waits = {}, {}, {}
    for run in sorted({a[0] for a in attempts}):
        tried, settled = defaultdict(int), {}
        delay, per_iteration = initial, defaultdict(list)
        for _, asin, seq, cls in sorted((a for a in attempts if a[0] == run), key=lambda a: a[2]):
            if asin in settled or tried[asin] >= limit:
                continue
            tried[asin] += 1
            if cls == "retry":
                delay += delta
            elif cls == "ok" and delay >= delta:
                delay -= delta
            if cls in final:
                settled[asin] = cls
            effective[(run, asin, seq)] = (cls, tried[asin], delay)
            per_iteration[tried[asin]].append((seq, delay))
        for asin, n in tried.items():
            outcomes[(run, asin)] = (settled.get(asin, "unscraped"), n)
        waits[run] = sum(d for rows in per_iteration.values() for _, d in rows[:-1])
    return effective, outcomes, waits


def test_classify(spark):
    replies = [
        (200, "<html>", "ok"), (200, "", "ok"), (200, None, "ok"), (404, "<html>", "invalid"),
        (404, ROBOT_CHECK, "invalid"), (502, "<html>", "retry"), (301, None, "retry"), (None, None, "lost"),
        (200, f"x{QUOTA_USED_UP}y", "retry"), (200, KEY_MISSING, "retry"), (200, f"<p>{ROBOT_CHECK}", "retry"),
        (200, ROBOT_CHECK.upper(), "ok"), (200, ROBOT_CHECK.replace("'", "&#39;"), "ok"),
    ]
    log = spark.createDataFrame(
        [("r", "info", "B", i, status, body) for i, (status, body, _) in enumerate(replies)], FETCH_LOG
    )
    got = [r["class"] for r in crawl.classify(log).orderBy("seq").collect()]
    assert got == [expected for _, _, expected in replies]
    pages = {r.seq: r.html for r in crawl.ok_pages(log).collect()}
    assert pages[1] == "" and pages[2] == "" and set(pages) == {0, 1, 2, 11, 12}


@pytest.mark.parametrize("limit", [20, 3])
@pytest.mark.parametrize("hot", [False, True])
def test_attempts_outcomes_delays(spark, hot, limit):
    attempts = random_attempts(11 + limit, hot=hot)
    expected, outcomes, waits = retell(attempts, limit)
    effective = crawl.effective_attempts(make_log(spark, attempts), max_iterations=limit)
    delays = crawl.adaptive_delay(effective)
    got = {(r.run_id, r.asin, r.seq): (r["class"], r.iteration, r.delay) for r in delays.collect()}
    assert got == expected
    assert {
        (r.run_id, r.asin): (r.outcome, r.attempts) for r in crawl.fetch_outcome(effective).collect()
    } == outcomes
    assert {r.run_id: r.wait_seconds for r in crawl.planned_wait(delays).collect()} == waits


@pytest.mark.parametrize("initial,delta", [(25, 10), (30, 10), (7, 10), (0, 3)])
def test_delay_start(spark, initial, delta):
    attempts = random_attempts(initial + delta)
    expected, _, _ = retell(attempts, initial=initial, delta=delta)
    delays = crawl.adaptive_delay(crawl.effective_attempts(make_log(spark, attempts)), initial=initial, delta=delta)
    assert {(r.run_id, r.asin, r.seq): r.delay for r in delays.collect()} == {k: v[2] for k, v in expected.items()}
    with pytest.raises(ValueError):
        crawl.adaptive_delay(delays, initial=-1)


@pytest.mark.parametrize("hot", [False, True])
def test_iteration_and_position(spark, hot):
    attempts = random_attempts(5, hot=hot)
    log = make_log(spark, attempts)
    count = defaultdict(int)
    iteration = {}
    for run, asin, seq, _ in attempts:
        count[run, asin] += 1
        iteration[run, asin, seq] = count[run, asin]
    got = {(r.run_id, r.asin, r.seq): r.iteration for r in crawl.attempt_iteration(log).collect()}
    assert got == iteration

    expected, _, _ = retell(attempts)
    lists = defaultdict(list)
    for (run, asin, seq), (_, n, _) in sorted(expected.items(), key=lambda e: e[0][2]):
        lists[run, n].append((run, asin, seq))
    positions = {k: (i + 1, len(v), i + 1 == len(v)) for v in lists.values() for i, k in enumerate(v)}
    placed = crawl.attempt_position(crawl.effective_attempts(log))
    assert {(r.run_id, r.asin, r.seq): (r.position, r.n_ids, r.is_last) for r in placed.collect()} == positions


def test_position_and_wait_with_cache_hits(spark):
    """Work lists gone through in order, some identifiers taken from the cache on the way."""
    rng = random.Random(9)
    attempts, cached, positions, waits, seq = [], [], {}, {}, 0
    for run in ("r0", "r1", "r2"):
        todo, hits, delay, waits[run] = [f"B{i:02d}" for i in range(15)], {f"B{i:02d}" for i in rng.sample(range(15), 6)}, 0, 0
        hits |= {"B14"} if run == "r1" else set()
        cached += [(run, "info", asin) for asin in hits]
        for iteration in range(1, 5):
            again = []
            for i, asin in enumerate(todo, 1):
                if asin in hits:
                    continue
                seq += 1
                cls = rng.choice(["ok", "retry", "retry", "invalid"])
                attempts.append((run, asin, seq, cls))
                delay += {"retry": 10, "ok": -10 if delay >= 10 else 0}.get(cls, 0)
                positions[(run, asin, seq)] = (iteration, i, len(todo), i == len(todo))
                waits[run] += delay if i < len(todo) else 0
                again += [asin] if cls == "retry" else []
            todo = again
    effective = crawl.effective_attempts(make_log(spark, attempts))
    hits = spark.createDataFrame(cached, "run_id string, page_kind string, asin string")
    got = crawl.attempt_position(effective, cached=hits)
    assert {
        (r.run_id, r.asin, r.seq): (r.iteration, r.position, r.n_ids, r.is_last) for r in got.collect()
    } == positions
    wait = crawl.planned_wait(crawl.adaptive_delay(effective), cached=hits)
    assert {r.run_id: r.wait_seconds for r in wait.collect()} == waits
    assert got.dtypes == crawl.attempt_position(effective).dtypes
    sizes = {(run, iteration): n for (run, _, _), (iteration, _, n, _) in positions.items()}
    summary = crawl.iteration_summary(effective, cached=hits).collect()
    assert {(r.run_id, r.iteration): r.n_ids for r in summary} == sizes
    assert {r.run_id: r.n_cached for r in summary if r.iteration == 1} == dict(Counter(run for run, _, _ in cached))


def test_request_error_retried(spark):
    attempts = random_attempts(3)
    _, expected, _ = retell(attempts, final=FINAL - {"lost"})
    effective = crawl.effective_attempts(make_log(spark, attempts), on_request_error="retry")
    got = crawl.fetch_outcome(effective, on_request_error="retry")
    assert {(r.run_id, r.asin): (r.outcome, r.attempts) for r in got.collect()} == expected
    with pytest.raises(ValueError):
        crawl.keep_effective(effective, on_request_error="guess")


def test_lists(spark):
    log = make_log(
        spark,
        [("r", "A", 1, "ok"), ("r", "B", 2, "retry"), ("r", "C", 3, "invalid"), ("r", "D", 4, "lost"),
         ("r", "B", 5, "retry"), ("r", "E", 6, "retry")],
    )
    requested = spark.createDataFrame([("r", "info", a) for a in "ABCDEFG"], "run_id string, page_kind string, asin string")
    cached = spark.createDataFrame([("G", "info")], "asin string, page_kind string")
    effective = crawl.effective_attempts(log, max_iterations=2)
    outcome = crawl.fetch_outcome(effective, requested=requested, cached=cached)
    assert {r.asin: r.outcome for r in outcome.collect()} == {
        "A": "ok", "B": "unscraped", "C": "invalid", "D": "lost", "E": "unscraped", "F": "unscraped", "G": "cached",
    }
    assert sorted(r.asin for r in crawl.unscraped(outcome).collect()) == ["B", "E", "F"]
    assert sorted(r.asin for r in crawl.invalid(outcome).collect()) == ["C"]
    assert sorted((r.asin, r.reason) for r in crawl.failed(outcome).collect()) == [
        ("B", "unscraped"), ("C", "invalid"), ("E", "unscraped"), ("F", "unscraped"),
    ]
    again = crawl.retry_worklist(requested, outcome, max_iterations=2)
    assert sorted(r.asin for r in again.collect()) == ["E", "F"]
    summary = {r.iteration: tuple(r)[3:] for r in crawl.iteration_summary(effective).collect()}
    assert summary == {1: (5, 1, 2, 1, 1), 2: (1, 0, 1, 0, 0)}


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_read_log(spark, tmp_path, form):
    log = make_log(spark, random_attempts(2, count=30))
    log.write.format(form).save(str(tmp_path / form))
    got = read_fetch_log(spark, str(tmp_path / form), form)
    assert got.dtypes == log.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, log.collect()))


def test_outcome_plan(spark, tmp_path):
    path = str(tmp_path / "log")
    make_log(spark, random_attempts(1)).write.parquet(path)
    plan = physical_plan(crawl.fetch_outcome(crawl.effective_attempts(spark.read.parquet(path))))
    assert plan.count("Exchange hashpartitioning") == 1
    # The limit works before the shuffle, and bodies do not cross it.
    assert "Partial" in plan and "WindowGroupLimit" in plan
    exchange = plan[: plan.index("Exchange hashpartitioning")]
    assert "body" not in exchange
    positions = physical_plan(crawl.attempt_iteration(spark.read.parquet(path)))
    assert "body" not in positions
