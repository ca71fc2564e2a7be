"""Tables as text: centred cells, a rule under the header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefacts.fixed_values import TRUNCATE_AFTER
from pagefacts.functions.text import double_text
from pagefacts.plans.staging import stage

_ELLIPSIS = "..."
_SEPARATOR = " │ "


def column_name(qualified: Column) -> Column:
    """Last part of a dotted name."""
    return F.element_at(F.split(qualified, r"\."), -1)


def cell_text(column: Column, kind: T.DataType) -> Column:
    """A value as text; NULL is None, a time has either no fraction or six digits."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.regexp_replace(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", "")
    elif isinstance(kind, T.BooleanType):
        text = F.initcap(column.cast("string"))
    elif isinstance(kind, T.DoubleType):
        text = double_text(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("None"))


def _texts(table: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [cell_text(F.col(c), table.schema[c].dataType).alias(c) for c in columns]


def _align(text: Column, wide: Column, room: Column, truncate_after: int) -> Column:
    """Cut to the limit where the column is wider than it, then centre, odd space to the right."""
    too_long = wide & (F.length(text) > truncate_after)
    cut = F.concat(F.substring(text, 1, truncate_after), F.lit(_ELLIPSIS))
    shown = F.when(too_long, cut).otherwise(text)
    size = F.when(too_long, truncate_after + len(_ELLIPSIS)).otherwise(F.length(text))
    left = F.repeat(F.lit(" "), F.shiftright(room - size, 1))
    return F.rpad(F.concat(left, shown), room, F.lit(" "))


def _layout(table: DataFrame, truncate_after: int) -> DataFrame:
    """One row: for each column whether it is wider than the limit, and the room its cells take."""
    columns = []
    for name in table.columns:
        wide = F.col(name) > truncate_after
        room = F.when(wide, truncate_after + len(_ELLIPSIS)).otherwise(F.col(name))
        columns += [wide.alias(f"_wide_{name}"), room.alias(f"_room_{name}")]
    return report_widths(table).select(*columns)


def _aligned(name: str, text: Column, truncate_after: int) -> Column:
    return _align(text, F.col(f"_wide_{name}"), F.col(f"_room_{name}"), truncate_after)


def report_widths(table: DataFrame) -> DataFrame:
    """One row: the longest text of each column, header included."""
    texts = table.select(*_texts(table, table.columns))
    longest = [
        F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(c))).alias(c) for c in table.columns
    ]
    return texts.agg(*longest)


def _laid_out(table: DataFrame, layout: DataFrame, keep: Sequence[str], truncate_after: int) -> DataFrame:
    """Aligned cells. The layout is one row whatever the table's size: joining it is a broadcast of one row."""
    keys = [F.col(c).alias(f"_key_{c}") for c in keep]
    texts = table.select(*keys, *_texts(table, table.columns))
    aligned = [_aligned(c, F.col(c), truncate_after).alias(c) for c in table.columns]
    return texts.crossJoin(F.broadcast(layout)).select(*[f"_key_{c}" for c in keep], *aligned)


def report_cells(table: DataFrame, *, keep: Sequence[str] = (), truncate_after: int = TRUNCATE_AFTER) -> DataFrame:
    """The table with every cell as aligned text; ``keep`` adds untouched columns as ``_key_<name>``."""
    return _laid_out(table, _layout(table, truncate_after), keep, truncate_after)


def report_lines(table: DataFrame, order: Sequence[str], *, truncate_after: int = TRUNCATE_AFTER) -> DataFrame:
    """The report as (section, line): 0 header, 1 rule, 2 the records in key order.

    The one-row layout is worked out once and written, for the header and the body.
    """
    layout = stage(_layout(table, truncate_after), "report-layout")
    header = [_aligned(c, F.lit(c), truncate_after) for c in table.columns]
    heading = layout.select(F.concat_ws(_SEPARATOR, *header).alias("line"))
    rule = F.regexp_replace(F.regexp_replace("line", "[^│]", "─"), "│", "┼")
    head = heading.select(F.posexplode(F.array(F.col("line"), rule)).alias("section", "line"))
    keys = [f"_key_{c}" for c in order]
    body = _laid_out(table, layout, order, truncate_after).select(
        F.lit(2).alias("section"), F.concat_ws(_SEPARATOR, *table.columns).alias("line"), *keys
    )
    both = body.unionByName(head, allowMissingColumns=True)
    return both.orderBy("section", *keys).select("section", "line")
