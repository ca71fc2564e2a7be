"""A filter on keys, for key lists of any size: a blocked Bloom filter built by aggregation.

Bodies should not be decoded or shuffled for keys that no list asks for. A key's hash picks one of a fixed number of
blocks of 32,768 bits and four bits in it. The blocks of a list are one row each, so the filter is
at most ``blocks`` times 4 KB (16 MB by default), however long the list, and is broadcast under that bound; the
plan is the same for ten keys and for ten million. The test runs in the scan, on built-in functions.

A listed key always passes. Others pass by chance: about 1 in 10,000 beside three million listed keys, 1 in 200
beside ten million, nearly all beside a hundred million, for which more blocks should be asked for.
An exact join on what comes out, narrow rows in most uses, settles the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.plans.staging import stage

# Bits of a block: what ``bitmap_construct_agg`` makes.
_BLOCK_BITS = 1 << 15
_BITS_PER_KEY = 4
BLOCKS = 4096


def _block(on: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), *on), F.lit(blocks)).cast("int")


def _bits(on: Sequence[str]) -> list[Column]:
    """Four numbers of 15 bits each."""
    hashed = F.xxhash64(F.lit("bits"), *on)
    return [F.shiftrightunsigned(hashed, 15 * i).bitwiseAND(F.lit(_BLOCK_BITS - 1)) for i in range(_BITS_PER_KEY)]


def key_filter(keys: DataFrame, on: Sequence[str], *, blocks: int = BLOCKS) -> DataFrame:
    """(block, bits) of a key list; written. Keys are brought together by block, in narrow rows."""
    placed = keys.select(_block(on, blocks).alias("block"), F.array(*_bits(on)).alias("at"))
    each = placed.repartition("block").select("block", F.explode("at").alias("at"))
    return stage(each.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")), "key-filter")


def may_be_listed(rows: DataFrame, listed: DataFrame, on: Sequence[str], *, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` without most of those whose key is not in the list that ``listed`` was made of."""
    return _tested(rows, listed, on, blocks, "inner").where("_met").select(*rows.columns)


def never_listed(rows: DataFrame, listed: DataFrame, on: Sequence[str], *, blocks: int = BLOCKS) -> DataFrame:
    """The rows that ``may_be_listed`` leaves out: their keys are not in the list for sure."""
    return _tested(rows, listed, on, blocks, "left").where("NOT coalesce(_met, false)").select(*rows.columns)


def _tested(rows: DataFrame, listed: DataFrame, on: Sequence[str], blocks: int, how: str) -> DataFrame:
    """``rows`` with ``_met``: whether the bits of the key are set; null if no listed key has its block."""

    def is_set(at: Column) -> Column:
        byte = F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), at.bitwiseAND(F.lit(7)).cast("int")) == 1

    bounded = F.broadcast(listed.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    met = rows.withColumn("_block", _block(on, blocks)).join(bounded, "_block", how)
    return met.select(*rows.columns, reduce(Column.__and__, map(is_set, _bits(on))).alias("_met"))


def only_listed(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` whose key is listed, selected where this stands in the plan.

    A semi join would say the same, but Spark moves it below projections and joins, to where rows are still wide.
    """
    return rows.join(keys.select(*on).distinct(), list(on)).select(*rows.columns)
