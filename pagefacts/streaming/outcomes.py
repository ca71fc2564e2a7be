"""Fetch outcomes as attempts arrive, by the batch operators over each micro-batch.

Between micro-batches only narrow rows are kept, in folders by run:

* ``open/run=R/slot=0|1``: the attempts of identifiers that are not settled yet, at most ``max_iterations``
  each, as they were after the last micro-batch that had attempts of the run. Each micro-batch writes the slot
  that the one before did not, so a micro-batch that is run again finds what it found the first time.
* ``settled/run=R/batch_id=N``: the outcomes that micro-batch N settled.
* ``unscraped/run=R/upto=N`` and ``closed/run=R``: what was open in a run when it was closed, and that it is closed.
* ``commits/batch_id=N``: one row, written last, with what the micro-batch did. What has no commit is not there
  for ``outcomes`` and ``close_runs``.

A micro-batch reads the folders of its own runs and no others, so it costs what its runs cost, however many
went before. R is a hash of the run's name, so any name makes a folder.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagefacts import fixed_values as fixed
from pagefacts.operators.crawl import KEY, classify, fetch_outcome, keep_effective
from pagefacts.plans.staging import scratch, stage

_STRING, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()


def _columns(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_KEYS = dict.fromkeys(KEY, _STRING)
# Columns of each table, and those its folders are named by. An ``open`` row without a class says that there was a batch.
_OPEN = _columns(**_KEYS, seq=_LONG, **{"class": _STRING}, batch_id=_LONG), ["run", "slot"]
_SETTLED = _columns(**_KEYS, outcome=_STRING, attempts=_INT), ["run", "batch_id"]
_UNSCRAPED = _columns(**_KEYS, outcome=_STRING, attempts=_INT), ["run", "upto"]
_CLOSED = _columns(run_id=_STRING, upto=_LONG), ["run"]
_TABLES = {"open": _OPEN, "settled": _SETTLED, "unscraped": _UNSCRAPED, "closed": _CLOSED}
# A folder of every table that is always there and holds nothing.
_NONE = "none"


def run_folder(run_id: Column) -> Column:
    return F.md5(run_id.cast("binary"))


def _create(spark: SparkSession, root: str) -> None:
    for name, (columns, parts) in _TABLES.items():
        folder = "/".join([f"run={_NONE}", *[f"{part}=-1" for part in parts[1:]]])
        spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{root}/{name}/{folder}")
    _commit(spark, root, -1, 0, mode="ignore")


def _read(spark: SparkSession, root: str, name: str, runs: list[str] | None = None) -> DataFrame:
    """A table, or only the folders of some runs. Folders that are not there are passed over."""
    columns, parts = _TABLES[name]
    held = [T.StructField(part, _STRING if part == "run" else _LONG) for part in parts]
    schema = T.StructType([*columns, *held])
    some = "*" if runs is None else f"{{{','.join([_NONE, *runs])}}}"
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/run={some}")


def _write(rows: DataFrame, root: str, name: str) -> None:
    """Replace the folders that ``rows`` has rows for, and leave the others. Large runs are spread over tasks."""
    columns, parts = _TABLES[name]
    with_run = rows.withColumn("run", run_folder(F.col("run_id"))).select(*columns.names, *parts)
    spread = with_run.hint("rebalance", *parts)
    (
        spread.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(f"{root}/{name}")
    )


def _open_after(spark: SparkSession, root: str, batch_id: int, runs: list[str] | None = None) -> DataFrame:
    """Rows of ``open`` as they were after a micro-batch, those that only say that there was one included."""
    rows = _read(spark, root, "open", runs).where(F.col("batch_id") <= batch_id)
    latest = rows.groupBy("run").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(latest, ["run", "batch_id"], "left_semi")


def last_commit(spark: SparkSession, root: str) -> int:
    """The last micro-batch that was written whole, -1 if there was none; from the names of the folders."""
    commits = spark.read.schema("n_runs long").parquet(f"{root}/commits/batch_id=*").inputFiles()
    return max(int(re.search(r"/batch_id=(-?\d+)/", file)[1]) for file in commits)


def _commit(spark: SparkSession, root: str, batch_id: int, n_runs: int, mode: str = "overwrite") -> None:
    row = spark.range(0, 1, 1, 1).select(F.lit(n_runs).cast("long").alias("n_runs"))
    row.write.mode(mode).parquet(f"{root}/commits/batch_id={batch_id}")


def stream_outcomes(
    log: DataFrame,
    root: str,
    checkpoint: str,
    *,
    max_iterations: int = fixed.MAX_ITERATIONS,
    on_request_error: str = "lost",
    **trigger,
) -> StreamingQuery:
    """Settle the identifiers of an arriving fetch log into tables under ``root``.

    Between micro-batches attempts must come in ``seq`` order; inside one they may not.
    Bodies are dropped in the scan. Every micro-batch replaces its own folders, so a batch that
    is run again replaces its rows. The names of the runs that one micro-batch has are collected, 32 characters each.
    ``root`` and ``checkpoint`` belong together. Stops when caught up, unless another trigger is given.
    """
    if on_request_error not in ("lost", "retry"):
        raise ValueError(f"on_request_error: {on_request_error!r}")
    _create(log.sparkSession, root)

    def settle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            n_runs = _settle(batch, root, batch_id, max_iterations, on_request_error)
        _commit(spark, root, batch_id, n_runs)

    return (
        log.writeStream.foreachBatch(settle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _settle(batch: DataFrame, root: str, batch_id: int, max_iterations: int, on_request_error: str) -> int:
    """Settle what a micro-batch allows to; the number of its runs."""
    spark = batch.sparkSession
    arrived = stage(classify(batch).select(*KEY, "seq", "class"), "arrived-attempts")
    runs = [row["run"] for row in arrived.select(run_folder(F.col("run_id")).alias("run")).distinct().collect()]
    if not runs:
        return 0
    closed = _read(spark, root, "closed", runs).select("run_id")
    arrived = arrived.join(closed, "run_id", "left_anti")
    before = _open_after(spark, root, batch_id - 1, runs)
    settled_before = _read(spark, root, "settled", runs).where(F.col("batch_id") < batch_id).select(*KEY)
    waiting = before.where(F.col("class").isNotNull()).join(closed, "run_id", "left_anti").select(*KEY, "seq", "class")
    waiting = waiting.unionByName(arrived.join(settled_before, KEY, "left_anti"))
    effective = stage(
        keep_effective(waiting, max_iterations=max_iterations, on_request_error=on_request_error), "effective-attempts"
    )
    outcome = fetch_outcome(effective, on_request_error=on_request_error)
    over = (F.col("outcome") != "unscraped") | (F.col("attempts") >= max_iterations)
    settled = stage(outcome.where(over), "settled")
    _write(settled.withColumn("batch_id", F.lit(batch_id).cast("long")), root, "settled")
    still_open = effective.select(*KEY, "seq", "class").join(settled.select(*KEY), KEY, "left_anti")
    there = arrived.select("run_id").distinct()
    blank = {c: F.lit(None).cast("string") for c in (*KEY[1:], "class")} | {"seq": F.lit(None).cast("long")}
    marks = there.withColumns(blank)
    slots = before.groupBy("run").agg(F.max("slot").alias("was"))
    run = run_folder(F.col("run_id"))
    rows = still_open.unionByName(marks).withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("run", run)
    slot = F.when(F.col("was") == 0, 1).otherwise(0).cast("long")
    _write(rows.join(slots, "run", "left").withColumn("slot", slot), root, "open")
    return len(runs)


def close_runs(spark: SparkSession, root: str, runs: DataFrame | None = None) -> None:
    """Close runs (``run_id``; all of them by default) while no stream is writing: what is open in them is unscraped.

    The unscraped rows of a run follow from the last commit and replace those of an earlier try; they count once the run
    is marked as closed, which is one file for every run. So closing that stopped half way is simply done again.
    """
    upto = last_commit(spark, root)
    closed = _read(spark, root, "closed").select("run_id")
    waiting = _open_after(spark, root, upto).join(closed, "run_id", "left_anti")
    over = waiting.select("run_id").distinct()
    if runs is not None:
        over = runs.select("run_id").distinct().join(closed, "run_id", "left_anti")
        waiting = waiting.join(over, "run_id", "left_semi")
    over = stage(over, "closing-runs")
    attempts = waiting.where(F.col("class").isNotNull()).groupBy(*KEY).agg(F.count("*").cast("int").alias("attempts"))
    at = F.lit(upto).cast("long").alias("upto")
    _write(attempts.select(*KEY, F.lit("unscraped").alias("outcome"), "attempts", at), root, "unscraped")
    _mark_closed(over.select("run_id", at), root)


def _mark_closed(over: DataFrame, root: str) -> None:
    _write(over, root, "closed")


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """One row per identifier that is settled, or was open when its run was closed."""
    closed = _read(spark, root, "closed").select("run_id", "upto")
    settled = _read(spark, root, "settled").where(F.col("batch_id") <= last_commit(spark, root))
    # A micro-batch that never came to its commit may have left rows of a run that was closed meanwhile.
    counted = settled.join(closed, "run_id", "left").where(F.col("upto").isNull() | (F.col("batch_id") <= F.col("upto")))
    unscraped = _read(spark, root, "unscraped").join(closed, ["run_id", "upto"], "left_semi")
    return counted.select(*KEY, "outcome", "attempts").unionByName(unscraped.select(*KEY, "outcome", "attempts"))
