"""Line dedup by overlapping windows of three lines.

Each window of three consecutive lines (blank lines are passed over) is hashed to 128 bits.
Counting finds the windows that occur more than once anywhere and their first place, by
doc_id and position; every other occurrence is a later one, and the lines that later
occurrences cover go. A line that goes has an equal line that stays, at or before the
first place of its window.

Windows travel as hashes and positions; counting combines before the shuffle, so a
window in a third of all documents is a row per task. When the occurrences meet the first place of
their window, those of hot windows (at most ``HOT``, by their share of all) are dealt over ``SALTS`` tasks by document.
Texts are shuffled once, to meet the positions to remove.

Defined cases: a null text stays null with no lines; texts of under three lines that are
not blank are left as they are; rows equal in doc_id and text are one document and get
the same result; a null doc_id comes before all others; other columns pass through
``dedup_lines`` unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.texts import NOT_SPACE, let, row_key
from pagefacts.plans.staging import stage

LINES = 3
# A window with more than this part of all repeated occurrences is hot, so there are no more than so many.
HOT = 512
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _worded(lines: Column) -> Column:
    """Positions of the lines that are not blank."""
    at = F.transform(lines, lambda line, i: F.when(line.rlike(NOT_SPACE), i))
    return F.array_compact(at)


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, key, at (which of the non-blank lines is the first), and the hash of each window."""

    def hashed(lines: Column) -> Column:
        def window(at: Column) -> Column:
            three = [F.get(lines, at + i) for i in range(LINES)]
            return F.struct(
                at.cast("int").alias("at"),
                F.xxhash64(*three).alias("h1"),
                F.xxhash64(F.lit("second"), *three).alias("h2"),
            )

        starts = F.sequence(F.lit(0), F.size(lines) - LINES)
        return F.when(F.size(lines) >= LINES, F.transform(starts, window))

    worded = F.filter(_lines(F.col("text")), lambda line: line.rlike(NOT_SPACE))
    return docs.select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.explode(let(worded, hashed)).alias("w")
    ).select("doc_id", "key", "w.*")


def later_windows(docs: DataFrame) -> DataFrame:
    """key and start of every occurrence of a window but its first."""
    found = windows(docs)
    place, window = F.struct("doc_id", "key", "at"), ["h1", "h2"]
    repeated = stage(
        found.groupBy(*window)
        .agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        .where(F.col("first") != F.col("last"))
        .select(*window, "first", "n"),
        "repeated-windows",
    )
    return _placed(found, repeated).where(place != F.col("first")).select("key", "at")


def _placed(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """Occurrences of repeated windows with the ``first`` place of their window."""
    window = ["h1", "h2"]
    occurrences = repeated.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > occurrences / HOT
    # Fewer than HOT rows, whatever the table.
    hot = repeated.where(is_hot).select(*window, F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = found.join(F.broadcast(hot), window, "left").select("doc_id", "key", "at", *window, salt)
    return dealt.join(repeated.select(*window, "first", F.explode(salts).alias("salt")), [*window, "salt"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, in struct column ``row``, and counts."""
    removed = later_windows(docs).groupBy("key").agg(F.collect_set("at").alias("starts"))
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text")
    rows = rows.withColumn("key", row_key(F.col("row.doc_id"), text))

    def kept(starts: Column, lines: Column) -> Column:
        def without(worded: Column) -> Column:
            covered = F.flatten(
                F.transform(starts, lambda at: F.array(*[F.get(worded, at + i) for i in range(LINES)]))
            )
            return F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)

        return let(_worded(lines), without)

    def cleaned(lines: Column) -> Column:
        stay = F.when(F.col("starts").isNotNull(), kept(F.col("starts"), lines))
        whole = F.struct(F.size(lines).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed"), text.alias("text"))
        return F.when(
            F.col("starts").isNull(), whole
        ).otherwise(
            let(
                stay,
                lambda at: F.struct(
                    F.size(lines).cast("bigint").alias("n_lines"),
                    (F.size(lines) - F.size(at)).cast("bigint").alias("n_removed"),
                    F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n").alias("text"),
                ),
            )
        )

    joined = rows.join(removed, "key", "left")
    lines = F.when(text.isNotNull(), _lines(text)).otherwise(F.array().cast("array<string>"))
    out = joined.select("row", let(lines, cleaned).alias("out"))
    return out.select(
        F.col("row").withField("text", F.col("out.text")).alias("row"), "out.n_lines", "out.n_removed"
    )


def dedup_sql(source: str = "documents") -> str:
    """doc_id, n_lines, n_removed and text as DuckDB SQL; doc_id must be unique there."""
    return f"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {source}),
    worded AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth
      FROM lines WHERE regexp_matches(line, '{NOT_SPACE}')),
    windows AS (
      SELECT doc_id, nth, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c,
        lead(pos) OVER w AS pos_b, lead(pos, 2) OVER w AS pos_c
      FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    later AS (
      SELECT * FROM windows WHERE c IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, nth) > 1),
    gone AS (
      SELECT doc_id, pos FROM later UNION SELECT doc_id, pos_b FROM later UNION SELECT doc_id, pos_c FROM later),
    joined AS (
      SELECT l.doc_id, l.pos, l.line, g.pos IS NULL AS stays
      FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos),
    cleaned AS (
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text
      FROM joined GROUP BY doc_id)
    SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
      c.text AS text
    FROM {source} d LEFT JOIN cleaned c ON d.doc_id = c.doc_id"""
