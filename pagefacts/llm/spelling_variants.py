"""Spelling variants: words one edit apart, by a reduced alphabet.

Every letter is hashed to one of a few symbols, so a word becomes a reduced word over a small alphabet, and
two words one edit apart have reduced words at most one edit apart. The neighbourhood of a
reduced word is generated in full as 64-bit numbers: a polynomial hash of a changed word follows from the hashes of
its parts, so a word of any length takes time in proportion to its neighbours. As being near is mutual, of
two reduced words one finds the other: the one with the lower symbol by replacing it, the longer one by deleting;
inserting would find the same pairs again. The neighbourhoods are joined with the reduced vocabulary,
and the words of two classes that met are compared as they are written, so hash collisions only cost time.

Words travel, not texts: runs are counted before they are shuffled. A class of reduced words is cut
into blocks of about ``BLOCK`` words, and a pair of blocks is the unit of work, so a class of any size spreads over
tasks. No pair is left out, whatever the number of symbols; more symbols mean more neighbours and fewer
words to compare, which suits larger vocabularies.

Defined cases: a null text has no words; a null doc_id counts as an empty one; equal runs of a document
change alike, so repeated rows count their words again; ties between forms go to the word
that is smaller in code-point order; words of any length take part; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.plans.staging import stage

LETTERS = "A-Za-zÀ-ÿ"
SYMBOLS = 8
# Words of a class that one task compares with those of another.
BLOCK = 256
# Spark's edit distance steps through both words; longer ones are compared by position.
LONG = 64
# A deletion is made in the runs whose checksum this divides.
EVERY = 31
LEAST_CHARS, LEAST_COUNT, AHEAD = 7, 2, 10
# Counts grow tenfold from form to form, so 64 bits allow 19 steps; rounds that double them, in SQL.
ROUNDS = 5
# Numbers of a task that are made at a time.
_CELLS = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def counted_words(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: lower-cased runs of letters, some of them with a letter deleted, that are long and frequent enough.

    A deletion makes a run shorter, so shorter runs than ``least_chars`` need not be looked at.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    summed = found.select("doc", lower.alias("run")).withColumn(
        "sum", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    )
    at = F.col("sum") % F.length("run")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("sum") % EVERY == 0, shorter).otherwise(F.col("run"))
    words = summed.select(word.alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _scrambled(numbers: np.ndarray) -> np.ndarray:
    """A fixed hash of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        numbers = (numbers ^ (numbers >> np.uint64(shift))) * np.uint64(factor)
    return numbers ^ (numbers >> np.uint64(31))


def _values(symbols: int) -> np.ndarray:
    return _scrambled(np.arange(1, symbols + 1, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE)
    steps[:1] = 1
    return np.cumprod(steps)


def _reduced(symbols: int):
    """Adds ``reduced``, the symbols as digits and letters, and ``h``, their polynomial hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.frombuffer((string.digits + string.ascii_lowercase).encode(), dtype=np.uint8)
        values = _values(symbols)
        for batch in batches:
            words = batch.column("word").to_pylist()
            codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
            ends = np.cumsum([len(word) for word in words], dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            symbol = (_scrambled(codes.astype(np.uint64) + np.uint64(1)) % np.uint64(symbols)).astype(np.int64)
            place = np.arange(len(codes)) - np.repeat(starts, ends - starts)
            powers = _powers(int(place.max(initial=-1)) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[symbol] * powers[place])])
            h = sums[ends] - sums[starts]
            text = digits[symbol].tobytes().decode()
            reduced = [text[start:end] for start, end in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(reduced, pa.string()), pa.array(h.view(np.int64))],
                names=["word", "n", "reduced", "h"],
            )

    return task


def _neighbourhoods(symbols: int):
    """(probe, home, blocks): every reduced word itself, with a symbol replaced by a higher one, and with one deleted."""

    def of_length(codes: np.ndarray, h: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Probes and the rows that they come from, for reduced words of one length."""
        n, length = codes.shape
        powers = _powers(length)
        own = values[codes] * powers
        yield h, np.arange(n)
        for symbol in range(1, symbols):
            row, at = np.nonzero(codes < symbol)
            yield h[row] + (values[symbol] * powers[at] - own[row, at]), row
        upto = np.cumsum(own, axis=1)
        # In a stretch of equal symbols it does not matter which one goes.
        first = np.ones((n, length), dtype=bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(first)
        yield upto[row, at] - own[row, at] + (h[row] - upto[row, at]) * _BACK, row

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _values(symbols)
        place = np.zeros(128, dtype=np.int64)
        for i, digit in enumerate((string.digits + string.ascii_lowercase).encode()):
            place[digit] = i
        for batch in batches:
            reduced = batch.column("reduced").to_pylist()
            lengths = np.array([len(word) for word in reduced], dtype=np.int64)
            h = batch.column("h").to_numpy().view(np.uint64)
            blocks = batch.column("blocks").to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                for some in np.array_split(rows, -(-len(rows) * length // _CELLS)):
                    letters = np.frombuffer("".join(reduced[i] for i in some).encode(), dtype=np.uint8)
                    codes = place[letters].reshape(len(some), length)
                    for probe, row in of_length(codes, h[some], values):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(probe.view(np.int64)), pa.array(h[some][row].view(np.int64)), pa.array(blocks[some][row])],
                            names=["probe", "home", "blocks"],
                        )

    return task


def _one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement makes one text of the other, in time proportional to their length."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = (np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) for text in (a, b))
    unequal = np.flatnonzero(x != y[: len(x)])
    at = int(unequal[0]) if len(unequal) else len(x)
    return bool(np.array_equal(x[at + (len(a) == len(b)) :], y[at + 1 :]))


def _near_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_one_edit(a, b) for a, b in zip(batch.column("word_1").to_pylist(), batch.column("word_2").to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _in_blocks(words: DataFrame, symbols: int) -> DataFrame:
    """word, n, reduced, h, and which of how many blocks of its class a word is in; written."""
    reduced = stage(words.mapInArrow(_reduced(symbols), "word string, n bigint, reduced string, h bigint"), "reduced-words")
    sizes = reduced.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    return stage(reduced.join(sizes, "h").withColumn("block", block), "word-classes")


def near_words(words: DataFrame, *, symbols: int = SYMBOLS) -> DataFrame:
    """word_1, n_1, word_2, n_2: every two of ``words`` (word, n; distinct) that are one edit apart, once."""
    if not 2 <= symbols <= 36:
        raise ValueError(f"symbols: {symbols}")
    classes = _in_blocks(words, symbols)
    homes = classes.select("reduced", "h", "blocks").distinct()
    probes = homes.mapInArrow(_neighbourhoods(symbols), "probe bigint, home bigint, blocks int")
    held = classes.groupBy("h").agg(F.first("blocks").alias("held_blocks"))
    met = probes.join(held, F.col("probe") == F.col("h"))
    one, other = F.struct(F.col("home").alias("h"), "blocks"), F.struct("h", F.col("held_blocks").alias("blocks"))
    # Two reduced words of one number may find a class twice.
    pairs = met.select(F.least(one, other).alias("one"), F.greatest(one, other).alias("other")).distinct()
    units = (
        pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("one.blocks") - 1)).alias("block_1"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("other.blocks") - 1)).alias("block_2"))
        .select(F.col("one.h").alias("h_1"), "block_1", F.col("other.h").alias("h_2"), "block_2")
        .where((F.col("h_1") != F.col("h_2")) | (F.col("block_1") <= F.col("block_2")))
    )
    left = classes.select(F.col("h").alias("h_1"), F.col("block").alias("block_1"), F.col("word").alias("word_1"), F.col("n").alias("n_1"))
    right = classes.select(F.col("h").alias("h_2"), F.col("block").alias("block_2"), F.col("word").alias("word_2"), F.col("n").alias("n_2"))
    # Inside a block every two words are met in both orders.
    once = (F.col("h_1") != F.col("h_2")) | (F.col("block_1") != F.col("block_2")) | (F.col("word_1") < F.col("word_2"))
    long = F.length("word_1") > LONG
    candidates = units.join(left, ["h_1", "block_1"]).join(right, ["h_2", "block_2"]).where(once)
    columns = ["word_1", "n_1", "word_2", "n_2"]
    near = candidates.where(~long & (F.levenshtein("word_1", "word_2", 1) == 1)).select(columns)
    of_long = candidates.where(long).select(columns)
    return near.unionByName(of_long.mapInArrow(_near_long, of_long.schema))


def forms(words: DataFrame, near: DataFrame, *, ahead: int = AHEAD) -> DataFrame:
    """word, form, n, n_near, form_n: the most frequent near word, where it has at least ``ahead`` times the count."""
    sides = [F.struct(F.col(f"word_{i}").alias("word"), F.struct((-F.col(f"n_{j}")).alias("n"), F.col(f"word_{j}").alias("word")).alias("near")) for i, j in ((1, 2), (2, 1))]
    both = near.select(F.explode(F.array(*sides)).alias("side")).select("side.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best.n"))
    far = F.col("form_n") >= ahead * F.col("n")
    return joined.select(
        "word", F.when(far, F.col("best.word")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(far, F.col("form_n")).alias("form_n"),
    )


def _last_forms(found: DataFrame) -> DataFrame:
    """word, root: forms followed to the last. Counts grow tenfold with every step, and every round doubles the steps."""
    links = stage(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(onward, "root", "left")
        links = stage(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def variants(docs: DataFrame, *, symbols: int = SYMBOLS, ahead: int = AHEAD, **least) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the documents."""
    words = stage(counted_words(docs, **least), "words")
    found = stage(forms(words, near_words(words, symbols=symbols), ahead=ahead), "word-forms")
    joined = found.join(_last_forms(found), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql() -> str:
    """The rows of ``variants`` with its defaults as DuckDB SQL: equal texts after taking out a letter meet."""
    doubled = ",\n    ".join(
        f"""roots_{i + 1} AS MATERIALIZED (
      SELECT a.word, coalesce(b.root, a.root) AS root FROM roots_{i} a LEFT JOIN roots_{i} b ON a.root = b.word)"""
        for i in range(ROUNDS)
    )
    return rf"""
    WITH bytes AS (
      SELECT list(list_reduce([b] || [0, 1, 2, 3, 4, 5, 6, 7],
        lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS crc FROM (SELECT range AS b FROM range(256))),
    runs AS (
      SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')),
        '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents),
    counted AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
    summed AS (
      SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(
          range(1, strlen(doc || ':' || run) + 1), lambda i: ('0x' || hex(encode(doc || ':' || run))[2 * i - 1:2 * i])::BIGINT),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS s
      FROM counted, bytes),
    changed AS (
      SELECT CASE WHEN s % {EVERY} = 0 THEN run[:(s % length(run))] || run[(s % length(run)) + 2:] ELSE run END AS word, n
      FROM summed),
    words AS (
      SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_CHARS}
      GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    cuts AS (
      SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
    near AS (
      SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
    best AS (
      SELECT word, count(*) AS n_near, min({{'n': -n, 'word': other}}) AS first FROM near GROUP BY word),
    formed AS MATERIALIZED (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -first.n >= {AHEAD} * w.n THEN first.word END AS form,
        CASE WHEN -first.n >= {AHEAD} * w.n THEN -first.n END AS form_n
      FROM words w LEFT JOIN best USING (word)),
    roots_0 AS MATERIALIZED (SELECT word, form AS root FROM formed WHERE form IS NOT NULL),
    {doubled}
    SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
    FROM formed f LEFT JOIN roots_{ROUNDS} r ON f.word = r.word"""
