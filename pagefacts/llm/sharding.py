"""Shards of nearly equal bytes by sampled splitters.

1. Keys are hashes of the text, so equal texts lie side by side. Rows are drawn into a sample
   with a probability in proportion to their size (decided by a hash of the row, so a rerun
   draws the same), and quantiles of the sampled keys cut the keys into ranges.
2. The bytes of every range are added up. Ranges of more than their fair share are subdivided
   by a second hash of the text, and a text that overfills one by itself by a hash of the row,
   each into as many parts as it needs. Other texts beside a hot one stay whole.
3. Rows are sorted within the parts; the running bytes, with the bytes of all parts before,
   give a row's place in the whole order, and that its shard: the n-th shard is the n-th
   equal portion of the bytes. Equal texts whose group is at most ``whole_part`` of a shard go where
   the group starts; larger groups are split where the portion ends.

So a shard's size is off by at most one row and that part of a shard. Only keys, sizes and hashes are
shuffled. There is a range for every million rows, and 80 sampled keys for every range: 80,000 numbers
on the driver for a billion rows; the totals of the parts are one row per part.

Defined cases: a null text has size 1 (no bytes, plus 1) and the hash of no text; an empty
table has no rows; rows equal in doc_id and text are interchangeable; a null doc_id is a
value like others; other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts.plans.staging import stage

SHARDS = 16
# Ranges at least, rows that one stands for, and sampled keys for each.
RANGES = 256
RANGE_ROWS = 1_000_000
RANGE_KEYS = 80
# A group of equal texts of up to this part of a shard stays in one shard.
WHOLE_PART = 0.05
_UNIT = 2.0**-63


def _unit(*columns: Column | str) -> Column:
    """A hash of the columns as a double from 0 up to 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1).cast("double") * F.lit(_UNIT)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key, second: all that is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _unit(text).alias("key"),
        F.xxhash64(F.lit("text"), text).alias("text_hash"),
        _unit(F.lit("second"), "doc_id", text).alias("second"),
    )


def splitters(rows: DataFrame, total: int, *, ranges: int, sample: int) -> list[float]:
    """Quantile bounds of a size-weighted sample of the keys; ``sample`` keys are expected."""
    chance = F.col("size") * (sample / max(total, 1))
    drawn = rows.where(_unit(F.lit("draw"), "second") < chance).select("key")
    # A row of more than total / sample bytes is in the sample once; the true sums below repair that.
    keys = sorted(k for (k,) in drawn.collect())
    cuts = {keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else set()
    return sorted(cuts)


def _subdivided(rows: DataFrame, sums: DataFrame, group: list[str], hashed: Column, name: str, fair: int) -> DataFrame:
    """Add ``name``: the groups in ``sums`` (group, bytes) get as many parts by ``hashed`` as they have fair shares.

    They are few enough to broadcast: each has at least a fair share, so there are no more than ranges.
    """
    parts = sums.select(*group, F.ceil(F.col("bytes") / fair).alias("parts"))
    return (
        rows.join(F.broadcast(parts), group, "left")
        .withColumn(name, F.floor(hashed * F.coalesce("parts", F.lit(1))).cast("int"))
        .drop("parts")
    )


def _over(rows: DataFrame, group: list[str], most: int) -> DataFrame:
    return rows.groupBy(*group).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most)


def _with_parts(rows: DataFrame, cuts: list[float], total: int) -> DataFrame:
    """Add range, part and piece. Overfull ranges are cut by text, and if a text is too large by itself, by row."""
    bounds = [float("-inf"), *cuts, float("inf")]
    if len(bounds) > 2:
        ranged = Bucketizer(splits=bounds, inputCol="key", outputCol="range").transform(rows)
    else:
        ranged = rows.withColumn("range", F.lit(0.0))
    ranged = ranged.withColumn("range", F.col("range").cast("int"))
    fair = max(1, math.ceil(total / (len(cuts) + 1)))
    by_text = _subdivided(ranged, _over(ranged, ["range"], fair), ["range"], _unit(F.lit("part"), "text_hash"), "part", fair)
    # What is still overfull holds a text of more than a fair share, or a long document; only such texts are cut.
    part, text = ["range", "part"], ["range", "part", "key", "text_hash"]
    still = by_text.join(F.broadcast(_over(by_text, part, 2 * fair).select(*part)), part, "left_semi")
    return _subdivided(by_text, _over(still, text, fair), text, F.col("second"), "piece", fair)


def shard_by_bytes(
    docs: DataFrame,
    shards: int = SHARDS,
    *,
    ranges: int | None = None,
    sample: int | None = None,
    whole_part: float = WHOLE_PART,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; shards 0 to ``shards`` - 1, slots gapless from 0."""
    rows = stage(keyed(docs), "shard-keys")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or max(RANGES, -(-n_rows // RANGE_ROWS))
    sample = sample or ranges * RANGE_KEYS
    parted = _with_parts(rows, splitters(rows, total, ranges=ranges, sample=sample), total)
    group = ["range", "part", "piece"]
    sums = parted.groupBy(*group).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    # One row per part: their number is set by ``ranges``, not by the data.
    before = sums.select(
        *group,
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    order = Window.partitionBy(*group).orderBy("key", "text_hash", "second", "doc_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*group, "key", "text_hash")
    placed = (
        parted.withColumn("bytes_in", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
        .withColumn("row_in", F.row_number().over(order) - 1)
        .withColumn("group_bytes", F.sum("size").over(same))
        .withColumn("group_start", F.min("bytes_in").over(same))
        .join(F.broadcast(before), group)
    )
    portion = total / shards if total else 1.0
    start = F.when(F.col("group_bytes") <= whole_part * portion, F.col("group_start")).otherwise(F.col("bytes_in"))
    at = F.floor((F.col("bytes_before") + start) * shards / F.lit(max(total, 1)))
    placed = stage(
        placed.select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(at, F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("row_in")).alias("row"),
        ),
        "shard-places",
    )
    # One row per shard.
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The texts as one folder per shard; ``doc_id`` must be unique."""
    rows = docs.select("doc_id", "text").join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).write.partitionBy("shard").parquet(path)
