"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in an order that looks random but is fixed, are cut into blocks. A
source of weight w gets block j released in slot floor(j / w) and due by slot ceil((j + 1) / w);
in every slot the released block with the earliest deadline is taken. Then after any number
of slots every source is less than one block away from its target.

Weights are whole shares of a period (``shares`` slots and more), so the schedule repeats
after one period. One period is worked out by a fold over its slots, a row per share; the
place of every block follows from that template by division, in parallel. Nothing depends
on the number of rows.

Every row is returned once, with its slot. ``in_mix`` is true up to the first slot for which
a source has no block left; up to there the weights hold. Later rows keep the order, without
the sources that have run out.

Target weights are given, or the sources' row counts to the power ``alpha``. The number of
sources bounds the template, not the number of rows; a source may hold any share of them.

Defined cases: a null source is a source of its own; rows equal in source, doc_id and text take
consecutive places; a source without a weight, or with weight 0, is an error; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts.llm.texts import row_key
from pagefacts.operators.ordered import with_dense_id
from pagefacts.plans.staging import stage

ALPHA = 0.7
SHARES = 1000
BLOCK_ROWS = 4


def target_shares(
    counts: DataFrame, *, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, shares: int = SHARES
) -> DataFrame:
    """source, share: at least 1 each; a source's target is its share of their sum. Takes (source, n_rows)."""
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(float(alpha))))
    else:
        given = counts.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        weighed = counts.join(
            given.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "left"
        ).drop("named")
        bad = F.col("weight").isNull() | ~(F.col("weight") > 0)
        weighed = weighed.withColumn(
            "weight", F.when(bad, F.raise_error(F.lit("a source has no weight"))).otherwise(F.col("weight"))
        )
    # One row per source, never per document.
    part = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))
    return weighed.select("source", F.greatest(F.lit(1), F.round(part * shares).cast("int")).alias("share"))


def _schedule(shares: Column) -> Column:
    """Source numbers in the order of the slots of one period, earliest deadline first."""

    def of_period(period: Column) -> Column:
        def step(state: Column, slot: Column) -> Column:
            def waiting(share: Column, source: Column) -> Column:
                block = F.get(state["next"], source)
                # Whole numbers: floor(j / w) and ceil((j + 1) / w) with w = share / period.
                release = F.floor(block * period / share)
                deadline = F.ceil((block + 1) * period / share)
                return F.when((block < share) & (release <= slot), F.struct(deadline.alias("due"), source.alias("source")))

            taken = F.array_min(F.transform(shares, waiting))["source"]

            def moved(source: Column) -> Column:
                following = F.transform(state["next"], lambda block, i: block + F.when(i == source, 1).otherwise(0))
                return F.struct(
                    following.alias("next"), F.concat(state["order"], F.array(source.cast("int"))).alias("order")
                )

            return F.transform(F.array(taken), moved)[0]

        start = F.struct(
            F.transform(shares, lambda _: F.lit(0)).alias("next"), F.array().cast("array<int>").alias("order")
        )
        slots = F.sequence(F.lit(0), period - 1)
        return F.aggregate(slots, start, step, lambda state: state["order"])

    total = F.aggregate(shares, F.lit(0), lambda a, b: a + b)
    return F.transform(F.array(total), of_period)[0]


def template(shares: DataFrame) -> DataFrame:
    """source, share, period, nth (block within the period), slot (within the period)."""
    listed = shares.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("sources"))
    placed = listed.select("sources", F.posexplode(_schedule(F.col("sources.share"))).alias("slot", "at")).select(
        F.get("sources", F.col("at")).alias("s"), "slot", F.expr("aggregate(sources.share, 0, (a, b) -> a + b)").alias("period")
    )
    nth = F.row_number().over(Window.partitionBy("s.source").orderBy("slot")) - 1
    return placed.select("s.source", "s.share", "period", nth.alias("nth"), "slot")


def schedule(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, key, slot, place (in the block), in_mix: one row per row of ``docs``."""
    narrow = docs.select("doc_id", "source", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    narrow = narrow.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return _placed(narrow, ["mark", "doc_id", "key"], **options).drop("mark")


def schedule_of_order(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``schedule`` and position (from 0), by the order in which the rows of ``docs`` come.

    The order inside each source is that of the rows as they were written: by file, then by row, however a scan packs the
    files. Rows that do not come from files are in the order of their partitions.
    """
    file = F.input_file_name()
    # Part numbers of more digits come later.
    order = {"_length": F.length(file), "_file": file, "_block": F.input_file_block_start(), "_row": F.monotonically_increasing_id()}
    narrow = docs.select("doc_id", "source", row_key(F.col("doc_id"), F.col("text")).alias("key"), *[c.alias(n) for n, c in order.items()])
    numbered = with_dense_id(narrow, list(order), name="position", start=0)
    return _placed(numbered.drop(*order), ["position"], **options)


def _placed(
    narrow: DataFrame,
    order: Sequence[str],
    *,
    weights: dict[str | None, float] | None = None,
    alpha: float = ALPHA,
    shares: int = SHARES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``narrow`` with slot, place and in_mix; ``order`` is that of the rows of a source."""
    # A dense id over (source, order) cuts a hot source into as many tasks as it needs.
    numbered = stage(with_dense_id(narrow, ["source", *order], name="n", start=0), "mix-order")
    sources = numbered.groupBy("source").agg(F.min("n").alias("first"), F.count("*").alias("n_rows"))
    sources = stage(sources, "mix-sources")
    plan = stage(
        template(target_shares(sources.select("source", "n_rows"), weights=weights, alpha=alpha, shares=shares)),
        "mix-template",
    )
    # One row per source, and one per share: bounded by the number of sources and of shares.
    cycle = plan.where("nth = 0").select(F.col("source").alias("s"), "share", "period")
    known = stage(
        sources.join(F.broadcast(cycle), F.col("source").eqNullSafe(F.col("s"))).select(
            "s", "first", "n_rows", "share", "period"
        ),
        "mix-cycles",
    )
    places = F.broadcast(plan.select(F.col("source").alias("source_of"), F.col("nth").alias("nth_of"), "slot"))
    at = F.col("s").eqNullSafe(F.col("source_of")) & (F.pmod(F.col("block"), F.col("share")) == F.col("nth_of"))
    # The first block each source lacks; the earliest of their slots ends the mix.
    lacking = known.withColumn("block", F.ceil(F.col("n_rows") / block_rows)).join(places, at)
    end = lacking.agg(F.min(_slot())).first()[0]
    return (
        numbered.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rank", F.col("n") - F.col("first"))
        .withColumn("block", F.floor(F.col("rank") / block_rows))
        .join(places, at)
        .select(
            *narrow.columns,
            _slot().alias("slot"),
            F.pmod(F.col("rank"), F.lit(block_rows)).cast("int").alias("place"),
            (_slot() < F.lit(end)).alias("in_mix"),
        )
    )


def _slot() -> Column:
    """Slot of a block: whole periods before it, and its place in the template."""
    return F.floor(F.col("block") / F.col("share")) * F.col("period") + F.col("slot")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the schedule, all rows and columns."""
    places = schedule(docs, **options).select("key", "slot", "place")
    places = places.groupBy("key").agg(F.min(F.struct("slot", "place")).alias("at"))
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumn("key", row_key(F.col("row.doc_id"), F.col("row.text")))
    joined = rows.join(places, "key")
    return joined.orderBy("at").select("row.*")


def mix_sql(alpha: float = ALPHA, shares: int = SHARES, block_rows: int = BLOCK_ROWS) -> str:
    """doc_id, source, slot, place and in_mix as DuckDB SQL; doc_id must be unique there."""
    return f"""
    WITH RECURSIVE counted AS (
      SELECT source, count(*) AS n_rows, pow(count(*)::DOUBLE, {alpha}) AS weight FROM documents GROUP BY source),
    shares AS (
      SELECT source, n_rows, greatest(1, round(weight / (SELECT sum(weight) FROM counted) * {shares})::INT) AS share,
        row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM counted),
    whole AS (SELECT list(share ORDER BY i) AS q, sum(share)::BIGINT AS period FROM shares),
    run(slot, pick, nxt) AS (
      SELECT -1::BIGINT, 0::BIGINT, list_transform(q, lambda x: 0::BIGINT) FROM whole
      UNION ALL
      SELECT slot + 1, pick, list_transform(nxt, lambda b, i: b + (i = pick)::BIGINT) FROM (
        SELECT slot, nxt, list_min(list_filter(list_transform(q, lambda s, i: CASE
            WHEN nxt[i] < s AND nxt[i] * period // s <= slot + 1
            THEN {{'due': ((nxt[i] + 1) * period + s - 1) // s, 'i': i::BIGINT}} END), lambda x: x IS NOT NULL)).i AS pick
        FROM run, whole WHERE slot + 1 < period)),
    plan AS (
      SELECT pick AS i, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS nth FROM run WHERE slot >= 0),
    ranked AS (
      SELECT doc_id, source, row_number() OVER (
        PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rnk FROM documents),
    placed AS (
      SELECT r.doc_id, r.source, r.rnk % {block_rows} AS place,
        (r.rnk // {block_rows} // s.share) * period + p.slot AS slot
      FROM ranked r JOIN shares s ON r.source IS NOT DISTINCT FROM s.source
      JOIN plan p ON p.i = s.i AND p.nth = r.rnk // {block_rows} % s.share, whole),
    lacking AS (
      SELECT min(b // share * period + p.slot) AS stop
      FROM (SELECT *, (n_rows + {block_rows - 1}) // {block_rows} AS b FROM shares) s
      JOIN plan p ON p.i = s.i AND p.nth = b % share, whole)
    SELECT doc_id, source, slot::BIGINT AS slot, place::INT AS place, slot < stop AS in_mix FROM placed, lacking"""
