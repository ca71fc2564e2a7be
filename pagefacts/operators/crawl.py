"""What a crawl decided, read off its fetch log.

Page bodies are only looked at in the scan, to classify an attempt. Everything
after that shuffles the narrow columns run_id, page_kind, asin, seq and class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts import fixed_values as fixed
from pagefacts.functions.text import clean_page
from pagefacts.operators.ordered import rank_in_group, reflected_walk

RUN = ["run_id", "page_kind"]
KEY = [*RUN, "asin"]
# The same key for grouping and sorting: identifiers differ most, so sorts decide on them first.
_BY_ID = ["asin", *RUN]


def usable(body: Column) -> Column:
    """False if the text holds one of the service's error or robot-check texts."""
    found = [F.contains(body, F.lit(marker)) for marker in fixed.UNUSABLE_MARKERS]
    return ~reduce(lambda a, b: a | b, found)


def classify(log: DataFrame) -> DataFrame:
    """Add ``class``: ok, retry, invalid (404) or lost (the request raised an exception)."""
    status = F.col("status")
    good = (status == 200) & usable(F.coalesce("body", F.lit("")))
    return log.withColumn(
        "class",
        F.when(status.isNull(), "lost").when(status == 404, "invalid").when(good, "ok").otherwise("retry"),
    )


def ok_pages(log: DataFrame) -> DataFrame:
    """Attempts that brought a page, with the page. An empty body is a page."""
    got = classify(log).where(F.col("class") == "ok")
    return got.select(*KEY, "seq", clean_page(F.coalesce("body", F.lit(""))).alias("html"))


def attempt_iteration(log: DataFrame) -> DataFrame:
    """Number the attempts of each identifier: its n-th attempt was made in iteration n."""
    return rank_in_group(log.select(*KEY, "seq"), _BY_ID, "seq", "iteration")


def effective_attempts(
    log: DataFrame,
    *,
    max_iterations: int = fixed.MAX_ITERATIONS,
    on_request_error: str = "lost",
) -> DataFrame:
    """The attempts that count: at most ``max_iterations`` per identifier, none after a final one.

    ``on_request_error="retry"`` tries an identifier again after an exception;
    the default gives it up.
    """
    attempts = classify(log).select(*KEY, "seq", "class")
    return keep_effective(attempts, max_iterations=max_iterations, on_request_error=on_request_error)


def keep_effective(
    attempts: DataFrame, *, max_iterations: int = fixed.MAX_ITERATIONS, on_request_error: str = "lost"
) -> DataFrame:
    """``effective_attempts`` of classified attempts, whatever other columns they have.

    The iteration limit is part of the question, and Spark applies it before the
    shuffle (WindowGroupLimit): a hot identifier leaves each task with no more
    than ``max_iterations`` rows.
    """
    if on_request_error not in ("lost", "retry"):
        raise ValueError(f"on_request_error: {on_request_error!r}")
    final = _is_final(F.col("class"))
    if on_request_error == "retry":
        final = final & (F.col("class") != "lost")
    in_order = Window.partitionBy(*_BY_ID).orderBy("seq")
    ended = F.max(final).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        attempts.withColumn("iteration", F.row_number().over(in_order))
        .where(F.col("iteration") <= max_iterations)
        .withColumn("_ended", ended)
        .where(~F.coalesce("_ended", F.lit(False)))
        .drop("_ended")
    )


def _is_final(cls: Column) -> Column:
    return cls.isin("ok", "invalid", "lost")


def fetch_outcome(
    effective: DataFrame,
    *,
    on_request_error: str = "lost",
    requested: DataFrame | None = None,
    cached: DataFrame | None = None,
) -> DataFrame:
    """One row per identifier: its final class, or unscraped if there was none.

    The last effective attempt decides. ``requested`` adds identifiers without any
    attempt; ``cached`` lists those taken from the cache, whose outcome is cached.
    Takes the result of ``effective_attempts`` and needs no further shuffle for it.
    """
    final = _is_final(F.col("_last"))
    if on_request_error == "retry":
        final = final & (F.col("_last") != "lost")
    outcome = (
        effective.groupBy(*_BY_ID)
        .agg(F.max_by("class", "iteration").alias("_last"), F.max("iteration").alias("attempts"))
        .select(*KEY, F.when(final, F.col("_last")).otherwise("unscraped").alias("outcome"), "attempts")
    )
    if requested is not None:
        outcome = (
            requested.select(*KEY)
            .distinct()
            .join(outcome, KEY, "left")
            .fillna({"outcome": "unscraped", "attempts": 0})
        )
    if cached is not None:
        hit = cached.select("asin", "page_kind").distinct().withColumn("_hit", F.lit(True))
        outcome = outcome.join(hit, ["asin", "page_kind"], "left").select(
            *KEY,
            F.when(F.col("_hit"), "cached").otherwise(F.col("outcome")).alias("outcome"),
            "attempts",
        )
    return outcome


def unscraped(outcome: DataFrame) -> DataFrame:
    return outcome.where(F.col("outcome") == "unscraped").select(*KEY)


def invalid(outcome: DataFrame) -> DataFrame:
    return outcome.where(F.col("outcome") == "invalid").select(*KEY)


def failed(outcome: DataFrame) -> DataFrame:
    """Unscraped and invalid identifiers together, with the reason; one pass instead of a union."""
    both = outcome.where(F.col("outcome").isin("unscraped", "invalid"))
    return both.select(*KEY, F.col("outcome").alias("reason"))


def retry_worklist(
    requested: DataFrame, outcome: DataFrame, *, max_iterations: int = fixed.MAX_ITERATIONS
) -> DataFrame:
    """Identifiers to try in the next iteration: not settled, iterations left.

    Both sides hold one row per identifier, so no key can be hot.
    """
    settled = outcome.where((F.col("outcome") != "unscraped") | (F.col("attempts") >= max_iterations))
    return requested.select(*KEY).distinct().join(settled.select(*KEY), KEY, "left_anti")


def iteration_summary(effective: DataFrame, *, cached: DataFrame | None = None) -> DataFrame:
    """Size of each iteration's work list and what became of it.

    ``cached`` (run_id, page_kind, asin) adds what a run took from the cache, in its first iteration.
    """
    rows, classes = effective.select(*RUN, "iteration", "class"), ["ok", "retry", "invalid", "lost"]
    if cached is not None:
        hits = cached.select(*RUN, F.lit(1).alias("iteration"), F.lit("cached").alias("class"))
        rows, classes = rows.unionByName(hits), [*classes, "cached"]
    counts = [F.count_if(F.col("class") == cls).alias(f"n_{cls}") for cls in classes]
    return rows.groupBy(*RUN, "iteration").agg(F.count("*").alias("n_ids"), *counts)


def attempt_position(effective: DataFrame, *, cached: DataFrame | None = None) -> DataFrame:
    """Position "i of n" of each attempt within its iteration, and whether it is the last.

    One iteration of one run may be most of the log, hence the rank that splits hot
    groups. Identifiers a run took from the cache leave no attempt; ``cached``
    (run_id, page_kind, asin) has them count in their place of the first iteration,
    whose work list is in order of the identifiers, as every later one is.
    """
    group = [*RUN, "iteration"]
    if cached is None:
        ranked = rank_in_group(effective.select(*KEY, "seq", "iteration"), group, "seq", "position", "n_ids")
    else:
        hits = cached.select(*KEY, F.lit(None).cast("bigint").alias("seq"), F.lit(1).alias("iteration"))
        listed = effective.select(*KEY, "seq", "iteration").unionByName(hits)
        ranked = rank_in_group(listed, group, "asin", "position", "n_ids").where(F.col("seq").isNotNull())
    return ranked.withColumn("is_last", F.col("position") == F.col("n_ids"))


def adaptive_delay(
    effective: DataFrame, *, initial: int = fixed.INITIAL_DELAY, delta: int = fixed.DELAY_DELTA
) -> DataFrame:
    """Seconds to wait after each attempt.

    A page takes ``delta`` off if the delay is at least that long, a retry adds
    ``delta``, anything else leaves it: a walk in steps of ``delta`` kept above 0.
    """
    if initial < 0 or delta <= 0:
        raise ValueError("initial must not be negative and delta must be positive")
    steps, rest = divmod(initial, delta)
    step = F.when(F.col("class") == "ok", -1).when(F.col("class") == "retry", 1).otherwise(0)
    attempts = effective.select(*KEY, "seq", "iteration", "class")
    walked = reflected_walk(attempts, RUN, "seq", step, steps, "_level")
    return walked.withColumn("delay", F.col("_level") * delta + rest).drop("_level")


def planned_wait(delays: DataFrame, *, cached: DataFrame | None = None) -> DataFrame:
    """Total seconds a run waited: every delay but the one after an iteration's last identifier.

    The last attempt's delay is subtracted instead of flagged, so two small
    aggregations do and no rank is needed. It stays if identifiers from the cache
    (``cached``: run_id, page_kind, asin) came after it in the first work list.
    """
    per_iteration = delays.groupBy(*RUN, "iteration").agg(
        F.sum("delay").alias("_all"), F.max_by("delay", "seq").alias("_after_last"), F.max("asin").alias("_tried")
    )
    not_waited = F.col("_after_last")
    if cached is not None:
        last_hit = cached.groupBy(*RUN).agg(F.max("asin").alias("_hit"))
        per_iteration = per_iteration.join(last_hit, RUN, "left")
        hit_came_last = (F.col("iteration") == 1) & (F.col("_hit") > F.col("_tried"))
        not_waited = F.when(hit_came_last, 0).otherwise(not_waited)
    return per_iteration.groupBy(*RUN).agg(F.sum(F.col("_all") - not_waited).alias("wait_seconds"))
