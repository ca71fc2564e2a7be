"""N-gram Jaccard join by chosen paths: texts whose sets of five-word shingles are 0.8 alike or more.

1. Documents with equal sets form a class; from here on a class is one row.
2. A run draws, by a hash of the token, a few tokens of each set: about ``SHARED`` of them
   are common to two sets at the threshold, for each of two levels of the path. Sets are split by the first
   token they chose. A bucket that is still large is split by the second one, unless most of
   its sets choose the same again, as the copies of one text do: splitting does not help there.
3. Buckets are brute-forced. A hot bucket of n sets is cut into about sqrt(n / ``SMALL``) blocks, or into
   as many as it takes to keep a block within ``BLOCK_ROWS`` and ``BLOCK_TOKENS``. Every pair of blocks is a unit of
   work, which compares its rows in tiles of bounded size. Runs are repeated until the expected recall is reached.
4. A pair may meet in several buckets. It counts in the first run in which it shares tokens
   of both levels, in the bucket of the smallest ones; this can be told from the two rows alone,
   so no list of pairs has to be made distinct. No pair leaves its tile: a task returns the sets that have any.
5. Their candidates are found again beside the whole sets, and verified exactly, tile by tile.
6. Verified links are counted per class; each block gives a spanning forest of its links,
   and the groups are the connected components.

Sets with at most 1 / rate tokens choose all of them. ``RUNS`` follows from ``RECALL``.

Defined cases: a text of one to four words has one shingle, all its words; a text without
words is in a class and group of its own, with no links; rows equal in doc_id and text are
copies of each other; a null doc_id comes before others; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts.llm.arrow import groups_of
from pagefacts.llm.texts import let, row_key, words
from pagefacts.plans.staging import stage

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
# Tokens that two sets at the threshold are expected to share, by level of the path.
SHARED = (3.0, 4.0)
# Buckets up to this size are not split further; a larger one that stays whole goes to several tasks.
SMALL = 512
# Rows on a side of the pieces in which a task compares its rows.
TILE = 1024
# What a block holds at most, in rows and in tokens of their sets: the memory of a task is that of two blocks.
BLOCK_ROWS = 8192
BLOCK_TOKENS = 2_000_000


def runs_for(recall: float, shared: tuple[float, float] = SHARED) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``."""
    met = math.prod(1 - math.exp(-s) for s in shared)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


RUNS = runs_for(RECALL)
LEVELS = len(SHARED)
SAMPLES = [f"s{run}_{level}" for run in range(RUNS) for level in range(LEVELS)]


def shingles(text: Column) -> Column:
    """Distinct hashes of the windows of five words."""

    def joined(left: Column, right: Column, by: int) -> Column:
        return F.zip_with(left, F.slice(right, F.lit(by + 1), F.size(right)), lambda x, y: F.xxhash64(x, y))

    def windows(all_words: Column) -> Column:
        def fives(fours: Column) -> Column:
            return F.slice(joined(fours, all_words, WORDS - 1), F.lit(1), F.size(all_words) - (WORDS - 1))

        long = let(let(joined(all_words, all_words, 1), lambda twos: joined(twos, twos, 2)), fives)
        short = F.when(F.size(all_words) > 0, F.array(F.xxhash64(all_words))).otherwise(F.array().cast("array<bigint>"))
        return F.array_distinct(F.when(F.size(all_words) >= WORDS, long).otherwise(short))

    return let(words(text), windows)


def _mixed(tokens: np.ndarray, seed: int) -> np.ndarray:
    """Tokens as evenly spread 64-bit numbers, another spread for every seed."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = tokens + step * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each stretch between offsets, empty ones too; wraps like the values."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set hash, size and the tokens chosen in every run and level, instead of the tokens."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        tokens = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        columns = [*batch.columns[:-1], pa.array(sizes, pa.int64())]
        for seed in (1000, 1001):
            columns.append(pa.array(_sums(_mixed(tokens, seed), offsets).view(np.int64)))
        short = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        for number in range(len(SAMPLES)):
            rate = SHARED[number % LEVELS] / (THRESHOLD * np.maximum(sizes, 1))
            chance = (_mixed(tokens, number) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            chosen = chance < np.repeat(rate, sizes)
            counts = _sums(chosen.astype(np.int32), offsets)
            cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(short[chosen], pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n", "h1", "h2", *SAMPLES])


def sampled_sets(docs: DataFrame) -> DataFrame:
    """doc_id, a, b (the row's key), n, h1, h2 (hash of the set) and the samples."""
    rows = docs.select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), shingles(F.col("text")).alias("tokens")
    ).select("doc_id", "key.a", "key.b", "tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()
    samples = ", ".join(f"{name} array<int>" for name in SAMPLES)
    return rows.mapInArrow(_sampled, f"doc_id {kind}, a bigint, b bigint, n bigint, h1 bigint, h2 bigint, {samples}")


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.repeat(np.arange(len(column)), np.diff(offsets))


def _shares(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For all pairs of rows, whether they have a value in common."""
    distinct, number, counts = np.unique(values, return_inverse=True, return_counts=True)
    common = counts[number] > 1
    if not common.any():
        return np.zeros((n, n), dtype=bool)
    columns, number = np.unique(number[common], return_inverse=True)
    held = np.zeros((n, len(columns)), dtype=np.float32)
    held[rows[common], number] = 1
    return held @ held.T > 0.5


def _candidate_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs that count in this bucket and whose sizes allow the threshold."""
    tiles = [np.arange(start, min(start + TILE, table.num_rows)) for start in range(0, table.num_rows, TILE)]
    if len(tiles) == 1:
        yield _pairs_of(table, tiles[0] * 0)
        return
    for i, left in enumerate(tiles):
        yield tuple(left[rows] for rows in _pairs_of(table.take(pa.array(left)), left * 0))
        for right in tiles[i + 1 :]:
            both = np.concatenate([left, right])
            side = np.repeat([0, 1], [len(left), len(right)])
            yield tuple(both[rows] for rows in _pairs_of(table.take(pa.array(both)), side))


def _pairs_of(table: pa.Table, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a table of few rows; if it has two sides, only those across them."""
    n = table.num_rows
    run, first, second = (table.column(c)[0].as_py() for c in ("run", "t0", "t1"))
    same_block = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
    size, cid, block = (table.column(c).to_numpy() for c in ("n", "cid", "block"))
    ok = np.minimum.outer(size, size) >= THRESHOLD * np.maximum.outer(size, size) - 1e-9
    ok &= cid[:, None] != cid[None, :]
    if not same_block:
        ok &= block[:, None] != block[None, :]
    if side.any():
        ok &= side[:, None] != side[None, :]
    ok = np.triu(ok, 1)
    if not ok.any():
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    values, rows = _flat(table, f"s{run}_0")
    before = values < first
    ok &= ~_shares(values[before], rows[before], n)
    values, rows = _flat(table, f"s{run}_1")
    ok &= _shares(values, rows, n)
    if second is not None:
        before = values < second
        ok &= ~_shares(values[before], rows[before], n)
    for earlier in range(run):
        if not ok.any():
            break
        ok &= ~(_shares(*_flat(table, f"s{earlier}_0"), n) & _shares(*_flat(table, f"s{earlier}_1"), n))
    return np.nonzero(ok)


_BUCKET = ["run", "t0", "t1_key", "bi", "bj"]
_MEMBER = [*_BUCKET, "t1", "block", "cid"]
_MEMBER_SCHEMA = "run int, t0 int, t1_key bigint, bi int, bj int, t1 int, block int, cid bigint"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of candidate pairs, one row per bucket and set; the pairs do not leave their tile."""
    out: list[pa.Table] = []
    for table in groups_of(batches, _BUCKET):
        if table.num_rows < 2:
            continue
        paired = np.zeros(table.num_rows, dtype=bool)
        for left, right in _candidate_pairs(table):
            paired[left] = True
            paired[right] = True
        if paired.any():
            out.append(table.select(_MEMBER).filter(pa.array(paired)))
        if sum(t.num_rows for t in out) > 20_000:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out = []
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each set in its bucket, and the smallest id of its tree in the bucket's forest.

    The pairs are found again and verified tile by tile, so no more than those of a tile are held.
    """
    out: list[list] = [[], [], []]
    for table in groups_of(batches, _BUCKET):
        cid = table.column("cid").to_numpy()
        values, rows = _flat(table, "tokens")
        _, number = np.unique(values, return_inverse=True)
        starts = np.searchsorted(rows, np.arange(len(cid) + 1))
        links = np.zeros(len(cid), dtype=np.int64)
        tree = np.arange(len(cid))
        marks = np.zeros(int(number.max()) + 1 if len(number) else 1, dtype=bool)
        for left, right in _candidate_pairs(table.drop_columns(["tokens"])):
            if len(left):
                _link(left, right, number, starts, marks, links, tree)
        linked = np.flatnonzero(links)
        least = np.full(len(cid), np.iinfo(np.int64).max)
        np.minimum.at(least, tree[linked], cid[linked])
        for column, found in zip(out, (cid[linked], links[linked], least[tree[linked]])):
            column.extend(found.tolist())
        if len(out[0]) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["cid", "links", "tree"])
            out = [[], [], []]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["cid", "links", "tree"])


def _link(
    left: np.ndarray,
    right: np.ndarray,
    number: np.ndarray,
    starts: np.ndarray,
    marks: np.ndarray,
    links: np.ndarray,
    tree: np.ndarray,
) -> None:
    """Verify the pairs of a tile: counted in ``links``, their labels made one in ``tree``."""
    sizes = np.diff(starts)
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    firsts = np.flatnonzero(np.diff(left, prepend=-1))
    for row, others in zip(left[firsts].tolist(), np.split(right, firsts[1:])):
        own = number[starts[row] : starts[row + 1]]
        marks[own] = True
        low, high = int(others.min()), int(others.max()) + 1
        if 4 * len(others) > high - low:
            held = marks[number[starts[low] : starts[high]]].astype(np.int32)
            common = np.add.reduceat(held, starts[low:high] - starts[low])[others - low]
        else:
            common = np.array([np.count_nonzero(marks[number[starts[o] : starts[o + 1]]]) for o in others.tolist()])
        marks[own] = False
        union = sizes[row] + sizes[others] - common
        # In whole numbers: common / union >= 4 / 5.
        similar = others[5 * common >= 4 * union]
        links[row] += len(similar)
        links[similar] += 1
        if (tree[similar] != tree[row]).any():
            merged = np.unique(np.append(tree[similar], tree[row]))
            tree[np.isin(tree, merged)] = merged[0]


def _at_place(df: DataFrame, keys: list[str], task: Callable, schema: str) -> DataFrame:
    """``task`` over rows brought together by ``keys``."""
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


def buckets(classes: DataFrame) -> DataFrame:
    """(run, t0, t1, cid) of the buckets to be brute-forced, each with its size and the tokens of its sets."""
    node = ["run", "t0"]

    def nodes_of(run: int) -> Column:
        return F.transform(f"s{run}_0", lambda t: F.struct(F.lit(run).alias("run"), t.alias("t0")))

    nodes = F.flatten(F.array(*[nodes_of(run) for run in range(RUNS)]))
    chosen = classes.select("cid", "n", F.explode(nodes).alias("node")).select("cid", "n", "node.*")
    sizes = chosen.groupBy(*node).agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where(F.col("size") > 1)
    first = stage(chosen.drop("n").join(sizes, node), "join-buckets")
    large = first.where(F.col("size") > SMALL)
    second_tokens = F.get(F.array(*[F.col(f"s{run}_1") for run in range(RUNS)]), F.col("run"))
    paths = (
        large.select("cid", *node, "size").join(classes.select("cid", "n", *[f"s{r}_1" for r in range(RUNS)]), "cid")
        .select("cid", "n", *node, "size", F.explode(second_tokens).alias("t1"))
    )
    inner = paths.groupBy(*node, "t1").agg(
        F.count("*").alias("inner_size"), F.sum("n").alias("inner_tokens"), F.first("size").alias("size")
    )
    # Copies of one text choose alike: such a bucket stays whole.
    split = inner.groupBy(*node).agg((2 * F.max("inner_size") < F.first("size")).alias("split")).where("split")
    split = stage(split.select(*node), "join-split")
    parts = paths.join(split, node, "left_semi").join(
        inner.where(F.col("inner_size") > 1).select(*node, "t1", "inner_size", "inner_tokens"), [*node, "t1"]
    )
    whole = first.join(split, node, "left_anti").withColumn("t1", F.lit(None).cast("int"))
    sized = parts.select("cid", *node, "t1", F.col("inner_size").alias("size"), F.col("inner_tokens").alias("tokens"))
    return whole.select("cid", *node, "t1", "size", "tokens").unionByName(sized)


def blocks(members: DataFrame) -> DataFrame:
    """Every row once for each pair of blocks it belongs to; a bucket of one block has one."""
    size, tokens = F.col("size"), F.col("tokens")
    count = F.ceil(F.greatest(F.sqrt(size / SMALL), size / BLOCK_ROWS, F.least(tokens / BLOCK_TOKENS, size))).cast("int")
    block = F.pmod(F.xxhash64("cid", "run", "t0"), count).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda other: F.struct(F.least(other, block).alias("bi"), F.greatest(other, block).alias("bj")),
    )
    placed = members.select("*", block.alias("block"), F.explode(pair).alias("pair")).select("*", "pair.*").drop("pair")
    key = F.coalesce(F.col("t1").cast("bigint"), F.lit(1 << 40))
    return placed.withColumn("t1_key", key)


def components(edges: DataFrame) -> DataFrame:
    """(cid, label): the smallest cid that is connected to it. Takes (cid, tree), a forest's links."""
    both = edges.select(F.col("cid").alias("u"), F.col("tree").alias("v")).where(F.col("u") != F.col("v"))
    both = stage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "join-edges")
    labels = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "join-labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        # Take the smallest label around, then the label of that label.
        stepped = labels.join(near, "u").select("u", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("u").alias("to"), F.col("label").alias("further"))
        moved = stage(
            stepped.join(jump, "to", "left").select(
                "u", F.least("to", F.coalesce("further", "to")).alias("label"), "was"
            ),
            "join-labels",
        )
        changed = moved.where(F.col("label") != F.col("was")).limit(1).count()
        labels = moved.select("u", "label")
        if not changed:
            return labels.select(F.col("u").alias("cid"), "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, a, b (its key), class_id, n_links, n_copies, copy_id.

    ``class_id`` is the smallest doc_id of the group of linked texts, ``copy_id`` that of the
    texts with the same shingles, of which there are ``n_copies``; ``n_links`` counts the other
    texts that are alike. ``first`` marks the row of the group that stays.
    """
    sets = stage(sampled_sets(docs), "join-sets")
    least = F.min(F.struct("doc_id", "a", "b"))
    same = sets.where("n > 0").groupBy("h1", "h2").agg(
        least.alias("least"), F.count("*").alias("n_copies"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in SAMPLES]
    )
    classes = stage(same.withColumn("cid", F.monotonically_increasing_id()), "join-classes")

    members = blocks(buckets(classes)).join(classes.select("cid", "n", *SAMPLES), "cid")
    found = stage(
        _at_place(members.drop("size", "tokens"), _BUCKET, _candidates, _MEMBER_SCHEMA), "join-candidates"
    )
    wanted = found.select("cid").distinct().join(classes.select("cid", "least", "n", *SAMPLES), "cid")
    wanted = wanted.select("cid", F.col("least.a").alias("a"), F.col("least.b").alias("b"), "n", *SAMPLES)
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").select("key.*", "text")
    # Repeated rows would give a set twice; any one of them will do.
    tokens = texts.join(wanted, ["a", "b"]).dropDuplicates(["cid"])
    tokens = tokens.select("cid", "n", *SAMPLES, shingles(F.col("text")).alias("tokens"))
    verified = stage(
        _at_place(found.join(tokens, "cid"), _BUCKET, _verified, "cid bigint, links bigint, tree bigint"),
        "join-links",
    )

    linked = verified.groupBy("cid").agg(F.sum("links").alias("n_links"))
    labels = components(verified.select("cid", "tree"))
    groups = (
        classes.select("cid", "h1", "h2", "least", "n_copies")
        .join(linked, "cid", "left")
        .join(labels, "cid", "left")
        .withColumn("label", F.coalesce("label", "cid"))
    )
    heads = groups.groupBy("label").agg(F.min("least").alias("head"))
    known = stage(groups.join(heads, "label").select("h1", "h2", "least", "head", "n_links", "n_copies"), "join-groups")
    own = F.struct("doc_id", "a", "b")
    joined = sets.select("doc_id", "a", "b", "n", "h1", "h2").join(known, ["h1", "h2"], "left")
    lone = F.col("n") == 0
    return joined.select(
        "doc_id",
        "a",
        "b",
        F.when(lone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("copy_id"),
        (lone | (own == F.col("head"))).alias("first"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of every group, all columns; texts without words stay."""
    stay = near_duplicates(docs).where("first").select("a", "b").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumn("key", row_key(F.col("row.doc_id"), F.col("row.text"))).select("row", "key.*")
    # Rows equal in doc_id and text share a key; the first of them stays.
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.lit(0)))
    kept = rows.join(stay, ["a", "b"], "left_semi").withColumn("nth", nth)
    return kept.where("nth = 1").select("row.*")


def join_sql() -> str:
    """doc_id, class_id, n_links, n_copies, copy_id as DuckDB SQL; small tables only, doc_id unique."""
    space = r"[^\x20\x09-\x0D]+"
    return f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{space}') AS w FROM documents),
    shingle AS (
      SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
    sets AS (SELECT doc_id, list(s ORDER BY s) AS l FROM shingle GROUP BY doc_id),
    classes AS (SELECT min(doc_id) AS copy_id, count(*) AS n_copies, len(l) AS n, l FROM sets GROUP BY l),
    tokens AS (SELECT copy_id, n, unnest(l) AS s FROM classes),
    links AS (
      SELECT a.copy_id AS x, b.copy_id AS y FROM tokens a JOIN tokens b ON a.s = b.s AND a.copy_id <> b.copy_id
      GROUP BY x, y, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
    reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    heads AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x),
    degrees AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
    SELECT d.doc_id, coalesce(h.class_id, c.copy_id, d.doc_id) AS class_id,
      coalesce(g.n_links, 0)::BIGINT AS n_links, coalesce(c.n_copies, 1)::BIGINT AS n_copies,
      coalesce(c.copy_id, d.doc_id) AS copy_id
    FROM d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN classes c ON s.l = c.l
    LEFT JOIN heads h ON h.x = c.copy_id LEFT JOIN degrees g ON g.x = c.copy_id"""
