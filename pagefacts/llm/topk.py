"""Exact top-k inner products by norm-bucketed retrieval.

1. Vectors are grouped by length: ranges of the length become buckets of bounded size, each
   stored as one packed block with its greatest length.
2. Every query gets a threshold that its k-th best score cannot be below: the k-th best
   score over a bounded sample of the candidates.
3. Queries are packed in blocks too. A block meets the buckets that any of its queries can
   need: those with threshold < length of the query * greatest length of the bucket.
4. In a bucket the threshold becomes a local cosine threshold for each query. Where it is high,
   coordinate pruning: on the query's largest coordinates, candidates of that
   cosine lie in a narrow range, and sorted lists give those in all ranges. Where it is low,
   length pruning: candidates are in order of length, and only those long enough count.
   What is left is verified by whole products.
5. The best k of every bucket are merged per query, at most k rows a bucket.

Products are exact whole numbers: 64-bit floats below 2**53, Python integers beyond. Bounds are
widened by a little, so rounding prunes nothing that belongs to the result.

Defined cases: vectors that are null, hold nulls or values that are not finite, or have no vec_id
take no part; components and scores beyond a 64-bit integer become the nearest one;
vectors of other dimensions than the query's do not meet it; rows are told apart by a number of their own in the
order of vec_id, so a repeated row is a query of its own, with the same query_id, and a candidate of its own, also for
its copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefacts.llm.arrow import groups_of
from pagefacts.operators.ordered import with_dense_id
from pagefacts.plans.staging import stage

K = 20
SCALE = 64
# Rows of a bucket and of a block of queries at most, and candidates sampled for the thresholds.
BUCKET_ROWS = 4096
QUERY_ROWS = 1024
SAMPLE_ROWS = 2048
# From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE = 0.6
FOCUS = 4
_EXACT = float(2**53)
_LEAST, _MOST = -(2**63), 2**63 - 1


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), dim, length; only vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    floor = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    takes_part = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    rows = vectors.where(takes_part).select(F.col("vec_id").cast("bigint").alias("vec_id"), floor.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda total, c: total + c * c)
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(squares).alias("length"))


def _packed(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """Rows in order of length in blocks of ``per_block``: ids, one array of values, lengths.

    The blocks are cut by a dense number over (dim, length), whatever the number of partitions.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["dim", "part"]):
            own = table.combine_chunks().to_batches()[0]
            lengths = own.column("length").to_numpy().astype("<f8")
            values = own.column("v").flatten().to_numpy().astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [
                    own.column("dim")[:1],
                    own.column("part")[:1],
                    pa.array([own.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                    pa.array([values.tobytes()], pa.binary()),
                    pa.array([lengths.tobytes()], pa.binary()),
                    pa.array([float(lengths.max())], pa.float64()),
                ],
                names=["dim", "part", "ids", "vectors", "lengths", "longest"],
            )

    numbered = with_dense_id(rows.withColumn("shorter", -F.col("length")), ["dim", "shorter", "vec_id"], name="nth", start=0)
    parted = numbered.withColumn("part", F.floor(F.col("nth") / per_block))
    sorted_rows = parted.repartition("dim", "part").sortWithinPartitions("dim", "part", "nth")
    packed = sorted_rows.select("dim", "part", "vec_id", "v", "length").mapInArrow(
        pack, "dim int, part bigint, ids binary, vectors binary, lengths binary, longest double"
    )
    return stage(packed.withColumn("block", F.format_string("%d/%d", "dim", "part")), name)


def _matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, dtype="<i8")
    return own, np.frombuffer(vectors, dtype="<f8").reshape(len(own), dim)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products; any sum of this many products of whole numbers below 2**53 is exact."""
    most = np.abs(left).max(initial=0.0) * np.abs(right).max(initial=0.0) * max(1, left.shape[1])
    if most < _EXACT:
        return left @ right.T
    wide = [[int(x) for x in row] for row in right]
    return np.array([[sum(int(a) * b for a, b in zip(row, other)) for other in wide] for row in left], dtype=object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > 4 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=int)


def _in_bucket(
    query_ids: np.ndarray,
    queries: np.ndarray,
    thresholds: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    lengths: np.ndarray,
    k: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores) of the best k per query that reach the query's threshold."""
    query_lengths = np.sqrt((queries * queries).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = thresholds / (query_lengths * lengths[0])
    # Without a threshold, or for a vector of length 0, nothing is pruned.
    local = np.where(np.isfinite(local), local, -1.0) * (1 - 1e-9) - 1e-9
    unit = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
    order = np.argsort(unit, axis=0, kind="stable")
    sorted_unit = np.take_along_axis(unit, order, axis=0)

    def chosen(at: int, candidates: np.ndarray, scores: np.ndarray):
        ok = (ids[candidates] != query_ids[at]) & (scores >= thresholds[at])
        candidates, scores = candidates[ok], scores[ok]
        best = _best(scores, ids[candidates], k)
        return int(query_ids[at]), ids[candidates][best], scores[best]

    # The longest first: the lengths from which each query's threshold can be reached.
    reach = np.where(query_lengths > 0, thresholds / np.where(query_lengths > 0, query_lengths, 1.0), -np.inf)
    reach = np.where(np.isfinite(reach), reach - np.abs(reach) * 1e-9 - 1e-9, -np.inf)
    long_enough = np.searchsorted(-lengths, -reach, side="right")
    by_length = np.flatnonzero((local < COORDINATE) & (long_enough > 0))
    for start in range(0, len(by_length), 256):
        part = by_length[start : start + 256]
        most = int(long_enough[part].max())
        scores = _products(queries[part], vectors[:most])
        for row, at in enumerate(part.tolist()):
            candidates = np.arange(long_enough[at])
            yield chosen(at, candidates, scores[row, : len(candidates)])

    for at in np.flatnonzero((local >= COORDINATE) & (local <= 1) & (long_enough > 0)).tolist():
        theta, unit_query = local[at], queries[at] / query_lengths[at]
        focus = np.argsort(-np.abs(unit_query))[:FOCUS]
        spread = np.sqrt(max(0.0, 1 - theta * theta) * np.maximum(0.0, 1 - unit_query[focus] ** 2)) + 1e-9
        middle = unit_query[focus] * theta
        # A unit vector within the angle of theta of the query has its coordinate in this range;
        # the axis itself is within that angle if the query's coordinate is beyond theta.
        low = np.where(unit_query[focus] <= -theta, -1.0, middle - spread) - 1e-9
        high = np.where(unit_query[focus] >= theta, 1.0, middle + spread) + 1e-9
        ranges = [
            (np.searchsorted(sorted_unit[:, c], lo, "left"), np.searchsorted(sorted_unit[:, c], hi, "right"), c)
            for c, lo, hi in zip(focus.tolist(), low.tolist(), high.tolist())
        ]
        first, last, column = min(ranges, key=lambda r: r[1] - r[0])
        candidates = order[first:last, column]
        for c, lo, hi in zip(focus.tolist(), low.tolist(), high.tolist()):
            candidates = candidates[(unit[candidates, c] >= lo) & (unit[candidates, c] <= hi)]
        if len(candidates):
            yield chosen(at, candidates, _products(queries[at : at + 1], vectors[candidates])[0])


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where ``is_query`` holds, the k best of all other rows."""
    numbered = with_dense_id(scaled(vectors), ["vec_id", "v"], name="n", start=0)
    named = stage(numbered.withColumn("asked", is_query), "topk-vectors")
    names = named.select("n", "vec_id")
    # From here on the number stands for the row; it follows vec_id, so ties go by it as well.
    rows = named.select(F.col("n").alias("vec_id"), "v", "dim", "length", "asked")
    # A fixed number of rows, whatever the size of the table; spread by a hash.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vec_id", "v", "dim").collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(row["dim"], []).append(row)
    known = {
        dim: (np.array([r["vec_id"] for r in group], dtype=np.int64), np.array([r["v"] for r in group], dtype=np.float64))
        for dim, group in by_dim.items()
    }
    shipped = vectors.sparkSession.sparkContext.broadcast(known)

    def with_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim")[0].as_py()
            ids, queries = _matrix(batch.column("ids")[0].as_py(), batch.column("vectors")[0].as_py(), dim)
            least = np.full(len(ids), -np.inf)
            if dim in shipped.value:
                others, values = shipped.value[dim]
                scores = _products(queries, values).astype(np.float64)
                scores[ids[:, None] == others[None, :]] = -np.inf
                if scores.shape[1] >= k:
                    # Beyond 2**53 the threshold is rounded: a little lower is still a bound.
                    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                    least = np.where(np.abs(least) < _EXACT, least, least - np.abs(least) * 1e-12)
            lengths = np.sqrt((queries * queries).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(lengths > 0, least / lengths, -np.inf)
            reach = np.where(np.isfinite(reach), reach - np.abs(reach) * 1e-9 - 1e-9, -np.inf)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in ("dim", "block", "ids", "vectors")],
                    pa.array([least.astype("<f8").tobytes()], pa.binary()),
                    pa.array([float(reach.min())], pa.float64()),
                ],
                names=["dim", "block", "q_ids", "q_vectors", "thresholds", "least_reach"],
            )

    def one_by_one(batches: Iterator[pa.RecordBatch], task) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield from task(iter([batch.slice(at, 1)]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = {name: batch.column(name)[0].as_py() for name in batch.schema.names}
            query_ids, queries = _matrix(value["q_ids"], value["q_vectors"], value["dim"])
            ids, candidates = _matrix(value["ids"], value["vectors"], value["dim"])
            found = _in_bucket(
                query_ids,
                queries,
                np.frombuffer(value["thresholds"], dtype="<f8"),
                ids,
                candidates,
                np.frombuffer(value["lengths"], dtype="<f8"),
                k,
            )
            rows = [(q, len(i), i, s) for q, i, s in found if len(i)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([r[0] for r in rows], [r[1] for r in rows]), pa.int64()),
                        pa.array(np.concatenate([r[2] for r in rows]), pa.int64()),
                        pa.array([max(_LEAST, min(_MOST, int(x))) for r in rows for x in r[3]], pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    buckets = _packed(rows, BUCKET_ROWS, "topk-buckets")
    queries = _packed(rows.where("asked"), QUERY_ROWS, "topk-queries")
    queries = stage(
        queries.select("dim", "block", "ids", "vectors").mapInArrow(
            lambda batches: one_by_one(batches, with_thresholds),
            "dim int, block string, q_ids binary, q_vectors binary, thresholds binary, least_reach double",
        ).withColumnRenamed("block", "q_block"),
        "topk-thresholds",
    )
    # Which bucket a block of queries needs is decided on one small row for each.
    needed = (
        queries.select("q_block", "dim", "least_reach")
        .join(buckets.select("block", "dim", "longest"), "dim")
        .where(F.col("longest") >= F.col("least_reach"))
        .select("q_block", "block")
    )
    pairs = needed.join(buckets, "block").join(queries.drop("dim", "least_reach"), "q_block")
    # A pair is a unit of work: spread them evenly, whichever bucket or queries they have.
    spread = pairs.repartition("q_block", "block")
    scored = spread.select("dim", "ids", "vectors", "lengths", "q_ids", "q_vectors", "thresholds").mapInArrow(
        lambda batches: one_by_one(batches, search), "query_id bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    queries_named = names.select(F.col("n").alias("query_id"), F.col("vec_id").alias("asked_id"))
    candidates_named = names.select(F.col("n").alias("vec_id"), F.col("vec_id").alias("found_id"))
    return (
        ranked.join(queries_named, "query_id")
        .join(candidates_named, "vec_id")
        .select(F.col("asked_id").alias("query_id"), "rank", F.col("found_id").alias("vec_id"), "score")
    )


def top_k_sql(k: int = K, scale: int = SCALE, every: int = 20) -> str:
    """The same as DuckDB SQL: all products."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""
    WITH v AS (
      SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND {finite}),
    scored AS (
      SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.n <> c.n)
    SELECT query_id, (row_number() OVER best)::INT AS rank, vec_id, score FROM scored
    WINDOW best AS (PARTITION BY n ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER best <= {k}"""
