"""Chat formatting of reply trees.

Messages name the message they answer. Iterative self-joins enumerate the paths from the roots to the leaves:
each round joins the links with themselves, so a link reaches twice as far as in the round before, and adds to
every leaf the ancestors within that reach; a tree of depth d takes about log2(d) rounds on
narrow rows, written between rounds. Paths are ranked within their tree by score (the sum of their
messages' scores, which has no score counting as 0), and the best ones are formatted, each as one
conversation with the spans under its loss mask.

The template is that of ``ChatTemplate``: a start mark, the role, a line end, the text, an end mark and a line end. A
control string inside a role or a text gets a backslash after its first character, and a backslash is doubled;
a line end in a role gets a backslash before it. So no role or text holds a control string any more, and ``unescaped``
gives back what was written.

A conversation is a row, so it must fit one. Messages are formatted before the shuffle that brings a conversation
together; finding paths moves no texts.

Defined cases: a null text or role is an empty one; null trees are one tree and a null node one node, both written
as empty; a node that occurs more than once is one message, the smallest by parent, role, text and score; a message whose
parent is null or unknown starts a path; parents that go round in a circle are refused; ties of scores go to the
smaller leaf; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts.operators.ordered import rank_in_group
from pagefacts.plans.staging import stage

NODE = ["tree", "node"]


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn, other control strings to escape, and the role whose texts are learned."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    learned: str = "assistant"

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for mark in (self.start, self.end, *self.others):
            text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
        return text

    def header(self, role: Column) -> Column:
        return F.concat(F.lit(self.start), F.replace(self.escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))

    def footer(self) -> Column:
        return F.lit(f"{self.end}\n")

    def turns(self) -> re.Pattern:
        """One turn of a formatted conversation: its role and its text, both escaped."""
        return re.compile(rf"{re.escape(self.start)}((?:[^\\\n]|\\.)*)\n(.*?){re.escape(self.end)}\n", re.DOTALL)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def messages(rows: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text, score) with one row per node and no nulls but in parent; written."""
    empty = F.lit("")
    clean = rows.select(
        *[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in NODE], F.col("parent").cast("string").alias("parent"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
        F.coalesce(F.col("score").cast("decimal(28,9)"), F.lit(0)).alias("score"),
    )
    first = clean.groupBy(*NODE).agg(F.min(F.struct("parent", "role", "text", "score")).alias("first"))
    return stage(first.select(*NODE, "first.*"), "messages")


def turn_messages(turns: DataFrame) -> DataFrame:
    """Messages of conversations given as rows (conv_id, turn, role, text): each turn answers the one before it.

    Rows of the same turn follow one another, by role and a hash of the text. Node numbers count the turns from 1.
    """
    empty = F.lit("")
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), empty).alias("tree"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
        F.col("turn").cast("bigint").alias("turn"), F.monotonically_increasing_id().alias("row"),
    )
    # Rows that agree in all but their number are the same, so it does not matter which is first.
    order = F.struct("turn", "role", F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"), "row")
    ranked = rank_in_group(rows.withColumn("order", order).drop("row", "turn"), ["tree"], "order", "node")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return ranked.select(
        "tree", F.col("node").cast("string").alias("node"), parent.cast("string").alias("parent"), "role", "text",
        F.lit(0).cast("decimal(28,9)").alias("score"),
    )


def _hops(links: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, above) of the ancestors 1, 2, 4, ... steps up, until there are none."""
    found, limit = [], links.count()
    hops = links
    while not hops.isEmpty():
        if 1 << len(found) > 2 * limit:
            raise ValueError("messages answer one another in a circle")
        found.append(hops)
        further = hops.select("tree", F.col("node").alias("above"), F.col("above").alias("further"))
        hops = stage(hops.join(further, ["tree", "above"]).select(*NODE, F.col("further").alias("above")), "hops")
    return found


def paths(given: DataFrame) -> DataFrame:
    """(tree, leaf, up, node): the messages of every path, ``up`` steps above its leaf; written."""
    nodes = given.select(*NODE)
    known = nodes.withColumnRenamed("node", "above")
    asked = given.select(*NODE, F.col("parent").alias("above")).where(F.col("above").isNotNull())
    links = stage(asked.join(known, ["tree", "above"], "left_semi").select(*NODE, "above"), "links")
    answered = links.select("tree", F.col("above").alias("node"))
    leaves = nodes.join(answered, NODE, "left_anti")
    reached = stage(leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("bigint").alias("up"), "node"), "paths")
    for k, hops in enumerate(_hops(links)):
        higher = reached.join(hops, NODE).select(
            "tree", "leaf", (F.col("up") + (1 << k)).alias("up"), F.col("above").alias("node")
        )
        reached = stage(reached.unionByName(higher), "paths")
    return reached


def best_paths(given: DataFrame, found: DataFrame, branches: int | None) -> DataFrame:
    """(tree, leaf, n_turns, score, rank) of the best paths of each tree; all of them, without a rank, for None."""
    scored = found.join(given.select(*NODE, "score"), NODE)
    totals = scored.groupBy("tree", "leaf").agg(F.count("*").alias("n_turns"), F.sum("score").alias("score"))
    if branches is None:
        return totals.withColumn("rank", F.lit(None).cast("int"))
    best_first = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    return totals.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= branches)


def conversations(given: DataFrame, *, branches: int | None = 1, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, n_turns, text, and the spans of text under the loss mask.

    ``given`` is what ``messages`` or ``turn_messages`` returns. Spans count code points; they hold the
    texts of the learned role as they are written, escaped.
    """
    found = paths(given)
    chosen = best_paths(given, found, branches)
    header, text = template.header(F.col("role")), template.escaped(F.col("text"))
    turns = given.select(
        *NODE, F.length(header).alias("before"), F.length(text).alias("chars"),
        (F.col("role") == template.learned).alias("learned"), F.concat(header, text, template.footer()).alias("piece"),
    )
    placed = found.join(chosen, ["tree", "leaf"]).join(turns, NODE)
    path = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    since = F.sum(F.length("piece").cast("bigint")).over(path.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(since, F.lit(0)) + F.col("before")
    turn = F.struct((-F.col("up")).alias("at"), "piece", F.when(F.col("learned"), F.struct(start.alias("start"), (start + F.col("chars")).alias("end"))).alias("span"))
    gathered = placed.select("tree", "leaf", "rank", "n_turns", turn.alias("turn")).groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"), F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("turns")
    )
    return gathered.select(
        "tree", "leaf", "rank", "n_turns", F.array_join("turns.piece", "").alias("text"), F.array_compact("turns.span").alias("loss")
    )


def _read_back(template: ChatTemplate):
    pattern = template.turns()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, text, loss in zip(*(batch.column(c) for c in ("tree", "text", "loss"))):
                text, turns, at, n = text.as_py(), hashlib.sha256(), 0, 0
                for turn in pattern.finditer(text):
                    if turn.start() != at:
                        break
                    role, said = (unescaped(part) for part in turn.groups())
                    turns.update(f"{role}\n{said}\n".encode())
                    at, n = turn.end(), n + 1
                if at != len(text):
                    raise ValueError(f"conversation {tree.as_py()!r} cannot be read at {at}")
                learned, chars = hashlib.sha256(), 0
                for span in loss.as_py():
                    said = unescaped(text[span["start"] : span["end"]])
                    learned.update(said.encode())
                    chars += len(said)
                rows.append((tree.as_py(), n, turns.hexdigest(), chars, learned.hexdigest(), len(text)))
            yield pa.RecordBatch.from_pylist([dict(zip(_REPORT.names, row)) for row in rows], schema=_REPORT)

    return task


_REPORT = pa.schema(
    [
        ("tree", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)
_REPORT_SQL = "tree string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame, *, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Counts and digests of turns and learned texts, taken from formatted conversations alone."""
    return formatted.select("tree", "text", "loss").mapInArrow(_read_back(template), _REPORT_SQL)


# A conversation whose texts consist of control strings.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    """The given conversations, and conversation -1 that says ``PROBE`` twice."""
    spark = turns.sparkSession
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def report(turns: DataFrame) -> DataFrame:
    """conv_id and what ``read_back`` finds, for the given conversations and conversation -1."""
    formatted = conversations(turn_messages(with_probe(turns)))
    kind = turns.schema["conv_id"].dataType
    conv_id = F.when(F.col("tree") != "", F.col("tree")).cast(kind)
    return read_back(formatted).select(conv_id.alias("conv_id"), *_REPORT.names[1:])


def report_sql(template: ChatTemplate = ChatTemplate()) -> str:
    """The rows of ``report`` as DuckDB SQL."""

    def escaped(text: str) -> str:
        text = f"replace({text}, chr(92), repeat(chr(92), 2))"
        for mark in (template.start, template.end, *template.others):
            text = f"replace({text}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
        return text

    marks = len(template.start) + len(template.end) + 2
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = '{template.learned}'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = '{template.learned}'), '')) AS loss_sha256,
      sum({marks} + length(replace({escaped("role")}, chr(10), chr(92) || chr(10))) + length({escaped("text")}))::BIGINT
        AS formatted_chars
    FROM turns GROUP BY conv_id"""
