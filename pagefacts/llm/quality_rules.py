"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every rule bounds a ratio of two counts of the text. The counts are columns, the rules
are rows of ``RULES``; a rule is written as a comparison of integers (100 * part against
percent * whole), so no rounding decides. There is no shuffle and no user function.

Defined cases: a null text is an empty one, has no words and fails; texts of under 20 words
fail; repeated rows each get their result; only doc_id and text are read of the input.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.texts import NOT_SPACE, let, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be by this from or an at "
    "de la le et les des en un une du que est pour qui dans par sur au pas il "
    "der die und das den von zu mit ist ein eine nicht auf dem sich im für als auch "
    "el los las y se del con para por su al lo una es no más"
).split()


class Rule(NamedTuple):
    """Fails if 100 * part is outside [least, most] * whole; an end that is None is open."""

    part: str
    whole: str
    least: int | None
    most: int | None


RULES = (
    Rule("word_chars", "n_words", 200, 2000),  # mean word length
    Rule("n_symbols", "n_words", None, 25),
    Rule("n_stop_words", "n_words", 2, None),
    Rule("n_dup_lines", "n_lines", None, 50),
    Rule("n_ellipsis_lines", "n_lines", None, 50),
    Rule("n_bullet_lines", "n_lines", None, 90),
)


def repeated_words(text_words: Column) -> Column:
    """Number of words inside windows of eight words that occur twice or more in the text.

    Windows are compared by 64-bit hash. Equal neighbours in the sorted hashes are the
    repeated ones; their start positions in order give the length of the union of the
    windows, each adding up to eight words until the next one starts. No step is
    quadratic in the length of the text.
    """

    def covered(starts: Column) -> Column:
        def added(start: Column, at: Column) -> Column:
            following = F.get(starts, at + 1)
            return F.when(following.isNull(), WINDOW).otherwise(F.least(following - start, F.lit(WINDOW)))

        return F.aggregate(F.transform(starts, added), F.lit(0), lambda total, x: total + x)

    def starts_of_repeated(ordered: Column) -> Column:
        def start(entry: Column, at: Column) -> Column:
            before = F.when(at > 0, F.get(ordered, at - 1)["hash"])
            after = F.get(ordered, at + 1)["hash"]
            equal = F.coalesce(entry["hash"] == before, F.lit(False)) | F.coalesce(
                entry["hash"] == after, F.lit(False)
            )
            return F.when(equal, entry["at"])

        return F.sort_array(F.array_compact(F.transform(ordered, start)))

    def count(hashes: Column) -> Column:
        entries = F.transform(hashes, lambda h, at: F.struct(h.alias("hash"), at.alias("at")))
        repeated = let(F.sort_array(entries), starts_of_repeated)
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, let(repeated, covered)).otherwise(0)

    def doubled(hashes: Column, by: int) -> Column:
        """Hashes of windows ``by`` long to hashes of windows twice as long."""
        shifted = F.slice(hashes, F.lit(by + 1), F.size(hashes))
        return F.zip_with(hashes, shifted, lambda x, y: F.xxhash64(x, y))

    def windows(all_words: Column) -> Column:
        eights = let(doubled(all_words, 1), lambda twos: let(doubled(twos, 2), lambda fours: doubled(fours, 4)))
        whole = F.slice(eights, F.lit(1), F.size(all_words) - (WINDOW - 1))
        return F.when(F.size(all_words) >= WINDOW, let(whole, count)).otherwise(0)

    return let(text_words, windows).cast("bigint")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules compare."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> list[Column]:
        stops = F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))
        return [
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.size(stops).cast("bigint").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        ]

    def of_lines(lines: Column) -> list[Column]:
        distinct = F.size(F.array_distinct(lines))
        return [
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - distinct).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)$"))).cast("bigint").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^ *[-*•]"))).cast("bigint").alias("n_bullet_lines"),
        ]

    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    return docs.select(
        "doc_id",
        let(words(F.col("text")), lambda w: F.struct(*of_words(w))).alias("w"),
        let(worded, lambda lines: F.struct(*of_lines(lines))).alias("l"),
        symbols.cast("bigint").alias("n_symbols"),
    ).select("doc_id", "w.*", "l.*", "n_symbols")


def failed(rule: Rule) -> Column:
    part, whole = 100 * F.col(rule.part), F.col(rule.whole)
    outside = [part < rule.least * whole] if rule.least is not None else []
    outside += [part > rule.most * whole] if rule.most is not None else []
    return reduce(lambda a, b: a | b, outside)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its counts, whether the base rules failed, and whether it is kept."""
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    broken = reduce(lambda a, b: a | b, [failed(rule) for rule in rules], F.lit(False))
    return measures(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~broken).alias("kept"),
        "n_stop_words",
        "n_lines",
        "n_ellipsis_lines",
        "n_bullet_lines",
    )


def rules_sql() -> str:
    """The same as DuckDB SQL over ``documents``."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    broken = " OR ".join(
        part
        for r in RULES
        for part in (
            [f"100 * {r.part} < {r.least} * {r.whole}"] if r.least is not None else []
        )
        + ([f"100 * {r.part} > {r.most} * {r.whole}"] if r.most is not None else [])
    )
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS l
      FROM documents),
    windows AS (
      SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
      FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
    repeated AS (
      SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
    covered AS (
      SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM repeated) GROUP BY r),
    m AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
        len(l)::BIGINT AS n_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)$')))::BIGINT AS n_ellipsis_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]')))::BIGINT AS n_bullet_lines
      FROM d LEFT JOIN covered USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      ({base}) AS base_failed, NOT ({base}) AND NOT ({broken}) AS kept,
      n_stop_words, n_lines, n_ellipsis_lines, n_bullet_lines
    FROM m"""
