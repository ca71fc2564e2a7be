"""Ranks, running sums and dense ids over an order, without giving one hot group to one task.

A plain window sends each group to a single task, which is fine until one
identifier or one run holds a large share of the log. Here rows are range-partitioned by
(groups, order), so a group of any size is cut where its rows reach a task's share. The window
runs inside each (partition, group); its result is written once. Only groups that cross a
partition border need more: at most two per partition, whose totals are accumulated and joined
back as a broadcast bounded by the number of partitions. The plan is the same for even
and for skewed data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts.plans.staging import stage

_PART = "_part"


def _in_parts(df: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """Rows with the number of their range; ranges follow (groups, order)."""
    return df.repartitionByRange(*groups, order).withColumn(_PART, F.spark_partition_id())


def _part_window(groups: Sequence[str]):
    return Window.partitionBy(_PART, *groups)


def _so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _earlier(groups: Sequence[str]):
    """All earlier parts of a group: a window over totals, never over rows."""
    return Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def _of_border_groups(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The rows of each partition's first and last group, the only ones that can go on in another partition."""
    group = F.struct(*groups)
    ends = rows.groupBy(_PART).agg(F.array(F.min(group), F.max(group)).alias("ends"))
    border = ends.select(_PART, F.explode(F.array_distinct("ends")).alias("end")).select(_PART, "end.*")
    return rows.join(F.broadcast(border), [_PART, *groups])


def rank_in_group(
    df: DataFrame, groups: Sequence[str], order: str, rank: str, size: str | None = None
) -> DataFrame:
    """1-based position of each row in its group, and the group size if ``size`` names a column.

    ``order`` is unique within a group; group columns are never NULL. Building the
    result writes the ranks inside the partitions (see ``stage``).
    """
    part = _part_window(groups)
    # Counts, because a rank as an integer may overflow.
    counted = _in_parts(df, groups, order).withColumn("_position", F.count("*").over(_so_far(part.orderBy(order))))
    if size:
        counted = counted.withColumn("_part_size", F.count("*").over(part))
    counted = stage(counted, "ranks")
    totals = _of_border_groups(counted, groups).groupBy(_PART, *groups).agg(F.max("_position").alias("_rows"))
    carried = totals.withColumn("_before", F.sum("_rows").over(_earlier(groups)))
    added = [(F.col("_position") + F.coalesce("_before", F.lit(0))).alias(rank)]
    if size:
        carried = carried.withColumn("_size", F.sum("_rows").over(Window.partitionBy(*groups)))
        added.append(F.coalesce("_size", "_part_size").alias(size))
    joined = counted.join(F.broadcast(carried.drop("_rows")), [_PART, *groups], "left")
    return joined.select(*df.columns, *added)


def reflected_walk(
    df: DataFrame, groups: Sequence[str], order: str, step: Column, start: int, level: str
) -> DataFrame:
    """Running level of a walk that starts at ``start``, moves by ``step`` and never goes below 0.

    With S the running sum including the start, the level after a row is
    S - least(0, lowest S so far). Sum and lowest value both combine across parts.
    The same holds for ``order`` and ``groups`` as for ranks.
    """
    so_far = _so_far(_part_window(groups).orderBy(order))
    walked = stage(
        _in_parts(df.withColumn("_step", step.cast("bigint")), groups, order)
        .withColumn("_sum", F.sum("_step").over(so_far))
        .withColumn("_low", F.min("_sum").over(so_far))
        .drop("_step"),
        "walks",
    )
    carried = (
        _of_border_groups(walked, groups)
        .groupBy(_PART, *groups)
        .agg(F.max_by("_sum", order).alias("_total"), F.min("_low").alias("_part_low"))
        .withColumn("_base", F.lit(start) + F.coalesce(F.sum("_total").over(_earlier(groups)), F.lit(0)))
        .withColumn("_low_before", F.min(F.col("_base") + F.col("_part_low")).over(_earlier(groups)))
        .select(_PART, *groups, "_base", "_low_before")
    )
    joined = walked.join(F.broadcast(carried), [_PART, *groups], "left")
    base = F.coalesce("_base", F.lit(start))
    # least() passes over a missing value: the first part has nothing before it.
    lowest = F.least(F.lit(0), "_low_before", base + F.col("_low"))
    return joined.select(*df.columns, (base + F.col("_sum") - lowest).cast("bigint").alias(level))


def with_dense_id(df: DataFrame, order: Sequence[str], *, name: str = "id", start: int = 1) -> DataFrame:
    """Number all rows start, start+1, ... in the given order, which must be unique.

    Range-partitioned and sorted in parallel, written once, then each partition is
    shifted by the rows before it. The offsets are one row per partition, so the
    broadcast cannot grow with the data.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "dense-id",
    )
    # The upper bits of a slot number the partition, the lower 33 the row in it.
    part = F.shiftright("_slot", 33)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("_rows")
    )
    inside = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select((F.col("_before") + inside + F.lit(start)).alias(name), *df.columns)
    )
