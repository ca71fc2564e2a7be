"""Secret scans over a trigram index, with built-in functions only.

1. From each rule's regular expression a Boolean query over trigrams is derived: an OR of
   ANDs of trigrams one of which every match must hold (in lower case). A rule whose
   matches need no trigram scans every text.
2. The index has a posting (trigram, document) for each trigram that some rule asks for.
3. Intersecting the postings of each AND gives the candidate documents of each rule.
4. Candidates are verified: the expression runs over their whole texts.

Postings are grouped by document, so they combine to a row per document and AND before the
shuffle, and a trigram in every document makes no hot group. Texts are shuffled once, to
meet their rules. Documents are told apart by a hash of doc_id and text; equal hashes would
only add a verification.

Defined cases: a null text is an empty one; repeated rows each get their result; an
empty table gives an empty result; only doc_id and text are read of the input.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser as regex_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.texts import let


class Rule(NamedTuple):
    """``group`` of a match must have at least ``least`` characters; else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds, in their order.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # Runs of 24 and more: what is left of [0-9a-f]+ when shorter ones are dropped.
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
# Public formats of keys.
ADDED = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

# A set of alternatives larger than this says nothing.
_MOST = 64
Conjunctions = frozenset[frozenset[str]]
# One AND without a trigram: always true.
ANYTHING: Conjunctions = frozenset([frozenset()])


def _or(*queries: Conjunctions) -> Conjunctions:
    united = frozenset().union(*queries)
    return frozenset(a for a in united if not any(b < a for b in united))


def _and(*queries: Conjunctions) -> Conjunctions:
    return reduce(lambda x, y: _or(frozenset(a | b for a, b in product(x, y))), queries, ANYTHING)


def _of_strings(strings: set[str]) -> Conjunctions:
    """Some one of the strings occurs."""
    return _or(*[frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _node(kind, value) -> tuple[set[str] | None, Conjunctions]:
    """All strings that the node can match, in lower case, if they are few; and its query."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANYTHING
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
        return {chr(c).lower() for _, c in value}, ANYTHING
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*[strings for strings, _ in parts]), ANYTHING
        return None, _or(*[_of_strings(s) if s is not None else q for s, q in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and most == 1:
            return strings | ({""} if least == 0 else set()), ANYTHING
        if strings is not None and least == most and len(strings) ** least <= _MOST:
            return {"".join(x) for x in product(strings, repeat=least)}, ANYTHING
        if least == 0:
            return None, ANYTHING
        return None, _of_strings(strings) if strings is not None else query
    return None, ANYTHING


def _sequence(nodes) -> tuple[set[str] | None, Conjunctions]:
    run, query, exact = {""}, ANYTHING, True
    for kind, value in nodes:
        strings, inner = _node(kind, value)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        query = _and(query, _of_strings(run), inner)
        run = strings if strings is not None else {""}
    if exact:
        return run, ANYTHING
    return None, _and(query, _of_strings(run))


def trigram_query(pattern: str) -> Conjunctions:
    """Every match of ``pattern`` holds, in lower case, all trigrams of some member."""
    strings, query = _sequence(regex_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(key, trigram) for each of the trigrams that the lower-case text holds. Takes (key, text)."""
    def held(lowered: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(t)), t) for t in trigrams]))

    return rows.select("key", F.explode(let(F.lower("text"), held)).alias("trigram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): the kinds whose trigram query a document satisfies."""
    asked = [
        (rule.kind, n, sorted(conjunction))
        for rule in rules
        for n, conjunction in enumerate(sorted(trigram_query(rule.pattern), key=sorted))
        if frozenset() not in trigram_query(rule.pattern)
    ]
    trigrams = sorted({t for _, _, conjunction in asked for t in conjunction})
    # One row for each trigram of each AND: bounded by the rules.
    wanted = rows.sparkSession.createDataFrame(
        [(kind, n, t, 1 << i, (1 << len(c)) - 1) for kind, n, c in asked for i, t in enumerate(c)],
        "kind string, conjunction int, trigram string, bit bigint, all_bits bigint",
    )
    found = (
        postings(rows, trigrams)
        .join(F.broadcast(wanted), "trigram")
        .groupBy("key", "kind", "conjunction")
        .agg(F.bit_or("bit").alias("bits"), F.first("all_bits").alias("all_bits"))
        .where(F.col("bits") == F.col("all_bits"))
    )
    return found.groupBy("key").agg(F.collect_set("kind").alias("rules"))


def _running(lengths: Column) -> Column:
    """Sum of all entries before each entry, in chunks so that no step copies the whole list per entry."""
    chunk = 256

    def sums(values: Column, start: Column) -> Column:
        def step(state: Column, value: Column) -> Column:
            return F.struct(
                (state["total"] + value).alias("total"),
                F.concat(state["before"], F.array(state["total"])).alias("before"),
            )

        begin = F.struct(start.cast("int").alias("total"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(values, begin, step, lambda state: state["before"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, b: a + b)

    def of_chunks(chunks: Column) -> Column:
        starts = sums(F.transform(chunks, total), F.lit(0))
        return F.flatten(F.zip_with(chunks, starts, lambda values, start: sums(values, start)))

    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / chunk).cast("int"))
    cut = F.transform(numbers, lambda i: F.slice(lengths, i * chunk + 1, F.lit(chunk)))
    return let(cut, of_chunks)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """(start, number, end) of the rule's leftmost non-overlapping matches, in code points.

    The text between the matches and the matches themselves give the places of both.
    """
    pattern = F.lit(rule.pattern)

    def placed(matches: Column) -> Column:
        between = F.transform(F.split(text, rule.pattern, -1), lambda piece: F.length(piece))
        value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches

        def of_lengths(lengths: Column) -> Column:
            # A piece and the match after it move the place by their lengths together.
            steps = F.zip_with(F.slice(between, F.lit(1), F.size(lengths)), lengths, lambda a, b: a + b)
            ends = F.zip_with(_running(steps), steps, lambda before, step: before + step)
            return F.zip_with(
                ends, lengths, lambda end, length: F.struct((end - length).alias("start"), F.lit(number).alias("kind"), end.alias("end"))
            )

        all_spans = let(F.transform(matches, lambda m: F.length(m)), of_lengths)
        checked = F.zip_with(all_spans, value, lambda span, v: F.when(F.length(v) >= rule.least, span))
        return F.when(F.size(matches) > 0, F.array_compact(checked)).otherwise(F.array())

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and ``spans``: (start, kind as a number, end) in order, one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"))
    joined = rows.join(candidates(rows.select("key", "text"), rules), "key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def of_rule(rule: Rule, number: int) -> Column:
        found = spans(F.col("text"), rule, number)
        if frozenset() in trigram_query(rule.pattern):
            return found
        asked = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        return F.when(asked, found).otherwise(none)

    found = F.concat(*[of_rule(rule, n) for n, rule in enumerate(rules)])
    return joined.select("doc_id", "text", F.sort_array(found).alias("spans"))


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("bigint")

    counts = [count(n).alias(f"n_{rule.kind}") for n, rule in enumerate(BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base, RULES), 256).alias("base_sha256"),
        _joined(F.col("spans"), RULES).alias("spans"),
    )


def report_sql() -> str:
    """The same as DuckDB SQL: every expression over every text, without the index."""
    found = " UNION ALL ".join(
        f"""
      SELECT r, {n} AS kind, '{rule.kind}' AS name, m, v, p FROM (
        SELECT r, regexp_extract_all(t, {_quoted(rule.pattern)}, 0) AS m,
          regexp_extract_all(t, {_quoted(rule.pattern)}, {rule.group}) AS v,
          string_split_regex(t, {_quoted(rule.pattern)}) AS p, {rule.least} AS least
        FROM d) WHERE len(m) > 0"""
        for n, rule in enumerate(RULES)
    )
    least = " ".join(f"WHEN {n} THEN {rule.least}" for n, rule in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {n}) AS n_{rule.kind}" for n, rule in enumerate(BASE))
    named = "name || ':' || start || ':' || stop"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({found}),
    each AS (SELECT r, kind, name, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM found),
    placed AS (
      SELECT r, kind, name, length(v[i]) AS held,
        list_sum(list_transform(p[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS n
      FROM each),
    spans AS (
      SELECT r, kind, name, start::BIGINT AS start, (start + n)::BIGINT AS stop FROM placed
      WHERE held >= CASE kind {least} END),
    summed AS (
      SELECT r, {counts},
        coalesce(string_agg({named}, ',' ORDER BY start, kind) FILTER (WHERE kind < {len(BASE)}), '') AS base,
        string_agg({named}, ',' ORDER BY start, kind) AS spans
      FROM spans GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0)::BIGINT AS n_{rule.kind}" for rule in BASE)},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN summed USING (r)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Places of one rule's matches in one text, for tests and small uses."""
    found = re.finditer(rule.pattern, text, re.ASCII)
    return [m.span() for m in found if len(m.group(rule.group)) >= rule.least]
