import random
import re

from conftest import physical_plan
from pyspark.sql import functions as F

from pagefacts.operators import ordered
from pagefacts.operators.ordered import rank_in_group, reflected_walk, with_dense_id
from pagefacts.plans.staging import stage


def skewed(spark, n=20_000):
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 7).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 4999).cast("string"))).alias("k"),
        (F.lit(n) - F.col("id")).alias("seq"),
    )


def even(spark, n=20_000):
    return spark.range(0, n, 1, 7).select((F.col("id") % 5000).cast("string").alias("k"), F.col("id").alias("seq"))


def positions(rows):
    groups = {}
    for k, seq in sorted(rows):
        groups.setdefault(k, []).append(seq)
    return {(k, s): (i + 1, len(v)) for k, v in groups.items() for i, s in enumerate(v)}


def test_ranks_across_parts(spark):
    for df in (skewed(spark), even(spark)):
        ranked = rank_in_group(df, ["k"], "seq", "rank", "size")
        expected = positions((r.k, r.seq) for r in df.collect())
        assert {(r.k, r.seq): (r.rank, r["size"]) for r in ranked.collect()} == expected
        assert ranked.dtypes == [("k", "string"), ("seq", "bigint"), ("rank", "bigint"), ("size", "bigint")]


def test_the_plan_is_the_same_for_skewed_and_even_data(spark):
    plans = [physical_plan(rank_in_group(df, ["k"], "seq", "rank", "size")) for df in (skewed(spark), even(spark))]
    names = [re.findall(r"^[\s:+*()\d-]*([A-Z]\w+)", plan, re.M) for plan in plans]
    assert names[0] == names[1] and "BroadcastHashJoin" in names[0]


def test_no_task_gets_more_than_a_few_fair_shares(spark, monkeypatch):
    """Nine tenths of the rows are one group, on many partitions."""
    parts = 400
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    staged = []
    monkeypatch.setattr(ordered, "stage", lambda df, label: staged.append(stage(df, label)) or staged[-1])
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        n = 100_000
        df = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 10 != 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("seq")
        )
        ranked = rank_in_group(df, ["k"], "seq", "rank")
        assert ranked.where("k = 'hot'").agg(F.max("rank"), F.sum("rank")).first()[:] == (90_000, 90_000 * 90_001 // 2)
        assert staged[0].groupBy("_part", "k").count().agg(F.max("count")).first()[0] <= 4 * n / parts
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_walk_across_parts(spark):
    draw = random.Random(8)
    steps = [(k, i, draw.choice([-1, -1, 1, 0])) for k, n in (("a", 5000), ("b", 40), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(steps, "k string, seq bigint, step int").repartition(5)
    walked = reflected_walk(df, ["k"], "seq", F.col("step"), 2, "level").collect()
    levels, expected = {}, {}
    for k, seq, step in steps:
        levels[k] = expected[k, seq] = max(0, levels.get(k, 2) + step)
    assert {(r.k, r.seq): r.level for r in walked} == expected


def test_empty(spark):
    df = skewed(spark).where("seq < 0")
    assert rank_in_group(df, ["k"], "seq", "rank", "size").count() == 0
    assert with_dense_id(df, ["k", "seq"]).count() == 0


def test_dense_id(spark):
    keys = [(f"{random.Random(i).random():.12f}", i) for i in range(5000)]
    df = spark.createDataFrame(keys, "a string, b int").repartition(6)
    rows = with_dense_id(df, ["a", "b"], start=11).collect()
    assert sorted((r.id, r.a, r.b) for r in rows) == [(i + 11, a, b) for i, (a, b) in enumerate(sorted(keys))]
