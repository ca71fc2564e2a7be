"""Last fields of CSV records that may go over several lines, read in parallel from files split anywhere.

A line break inside quotes belongs to the field, so what a line means depends on whether a quoted field is open where it
begins, which the lines before decide. Each line is therefore taken for a function of that one bit: it may keep the bit, turn
it over, or set it whatever it was. Such functions combine, so they are combined first inside every split of a file, in
parallel, then over the splits of a file, one row each, and every split is told how it begins.

Records that end in the line where their last field begins, which is nearly all, give their field there. Of
the others only the lines of the last field are brought together, by file and first line.

Lines end with a line feed, a carriage return or both; a byte order mark at the start of a file is dropped. Within
quotes any line end counts as a line feed. What the end of a file leaves open ends there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefacts.plans.staging import stage

# A field is quoted (with "" for a quote, and perhaps text after the closing quote)
# or runs up to the next comma. Possessive, so that long lines cannot backtrack.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_QUOTED = rf'"{_INSIDE}"[^,]*+'
_PLAIN = r'(?!")[^,]*+'
_FIELD = rf"(?:{_QUOTED}|{_PLAIN})"
_WHOLE = rf"(?s)\A{_FIELD}(?:,{_FIELD})*+\z"
_LAST = rf"(?s)\A(?:{_FIELD},)*+({_FIELD})\z"
_UNQUOTE = rf'(?s)\A"({_INSIDE})"([^,]*+)\z'
# The open field at the end of a line, and the rest of a field that an earlier line opened.
_OPENED = rf'(?s)\A(?:{_FIELD},)*+("{_INSIDE})\z'
_CLOSING = rf'(?s)\A{_INSIDE}"[^,]*+'

# Fixed value: the most characters a field may have.
FIELD_LIMIT = 131_072

_SPLIT, _PLACE = ["file", "block"], ["row", "part"]


def _unquoted(field: Column) -> Column:
    inner = F.replace(F.regexp_extract(field, _UNQUOTE, 1), F.lit('""'), F.lit('"'))
    return F.when(
        F.startswith(field, F.lit('"')), F.concat(inner, F.regexp_extract(field, _UNQUOTE, 2))
    ).otherwise(field)


def is_whole(line: Column) -> Column:
    """Whether every field that the line opens is closed in it."""
    return F.rlike(line, F.lit(_WHOLE))


def last_of_whole(line: Column) -> Column:
    return _unquoted(F.regexp_extract(line, _LAST, 1))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, part, line): block is where the split begins in its file; rows are in order inside a split."""
    place = [F.col(f"_metadata.{name}").alias(alias) for name, alias in (("file_path", "file"), ("file_block_start", "block"))]
    scanned = spark.read.option("lineSep", "\n").text(path).select(
        *place, F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("row"), "value"
    )
    lines = F.split(F.regexp_replace("value", r"\r\z", ""), "\r")
    cut = scanned.select("*", F.posexplode(lines).alias("part", "line"))
    # Read from the sizes whether the last line of a file has an end: a split gives lines without it.
    size = F.when(F.col("part") == 0, F.octet_length("value") + 1).otherwise(0)
    return cut.select(*_SPLIT, *_PLACE, "line", size.alias("size"), "file_size", F.endswith("value", F.lit("\r")).alias("returned"))


def _with_effect(lines: DataFrame) -> DataFrame:
    """``fixed`` (the bit after the line, if it does not depend on the one before) and ``turns`` (1 if it turns it over)."""
    line, more = F.col("line"), F.rlike("line", F.lit(_CLOSING + ","))
    if_closed = F.when(is_whole(line), 0).otherwise(1)
    closes = F.when(F.rlike(line, F.lit(_CLOSING + r"\z")), 0).otherwise(1)
    if_open = F.when(more, F.when(is_whole(_rest(line)), 0).otherwise(1)).otherwise(closes)
    effect = F.when(F.contains(line, F.lit('"')), F.struct(if_closed.alias("c"), if_open.alias("o")))
    found = lines.withColumn("_effect", effect)
    same = F.col("_effect.c") == F.col("_effect.o")
    turns = F.when(~same & (F.col("_effect.c") == 1), 1).otherwise(0)
    return found.withColumns({"fixed": F.when(same, F.col("_effect.c")), "turns": F.coalesce(turns, F.lit(0))}).drop("_effect")


def _rest(line: Column) -> Column:
    """What follows the comma after the field that was open."""
    return F.regexp_extract(line, _CLOSING + r",(.*)\z", 1)


def _combined(rows: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds what all earlier rows of a group do together: ``_turned`` times over since ``_set``, the last to set the bit."""
    before = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turned = rows.withColumn("_turned", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    setting = F.when(F.col("fixed").isNotNull(), F.struct("fixed", F.col("_turned").alias("at")))
    return turned.withColumn("_set", F.last(setting, ignorenulls=True).over(before))


def _bit(start: Column) -> Column:
    """The bit before a row, if it is ``start`` before its group."""
    since_set = F.col("_set.fixed").bitwiseXOR(((F.col("_turned") - F.col("_set.at")) % 2).cast("int"))
    return F.coalesce(since_set, start.bitwiseXOR((F.col("_turned") % 2).cast("int")))


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, opened): whether a quoted field is open where a split begins."""
    setting = F.coalesce(F.when(F.col("fixed").isNotNull(), F.struct("fixed", F.col("_turned").alias("at"))), F.col("_set"))
    last = F.max_by(F.struct((F.col("_turned") + F.col("turns")).alias("turned"), setting.alias("set")), F.struct(*_PLACE))
    ends = lines.groupBy(*_SPLIT).agg(last.alias("last")).select(*_SPLIT, "last.*")
    turned = F.col("turned") - F.coalesce("set.at", F.lit(0))
    effects = ends.select(
        *_SPLIT, F.col("set.fixed").bitwiseXOR((turned % 2).cast("int")).alias("fixed"),
        F.when(F.col("set").isNull(), turned % 2).otherwise(0).alias("turns"),
    )
    return _combined(effects, ["file"], ["block"]).select(*_SPLIT, _bit(F.lit(0)).alias("opened"))


def _limited(field: Column) -> Column:
    too_long = F.raise_error(F.lit(f"field of over {FIELD_LIMIT} characters"))
    return F.when(F.length(field) > FIELD_LIMIT, too_long.cast("string")).otherwise(field)


def last_fields(spark: SparkSession, path: str, *, on_blank: str = "fail") -> DataFrame:
    """(file, field): the last field of every record of a file or folder.

    ``on_blank`` says what a line without any character does between records: "fail" or "drop".
    A last field of over ``FIELD_LIMIT`` characters is an error, so a quote that is
    never closed does not gather a file in one row.
    """
    if on_blank not in ("fail", "drop"):
        raise ValueError(f"on_blank: {on_blank!r}")
    lines = stage(_combined(_with_effect(_lines(spark, path)), _SPLIT, _PLACE), "csv-lines")
    told = lines.join(_starts(lines), _SPLIT).withColumn("open", _bit(F.col("opened")) == 1)
    line = F.col("line")
    fresh = F.when(~F.col("open"), line).when(F.rlike(line, F.lit(_CLOSING + ",")), _rest(line))
    told = told.select(*_SPLIT, *_PLACE, "open", "line", fresh.alias("fresh")).withColumn(
        "whole", F.col("fresh").isNotNull() & is_whole(F.col("fresh"))
    )
    blank = ~F.col("open") & (line == "")
    ended = told.where(F.col("whole") if on_blank == "fail" else F.col("whole") & ~blank)
    stop = F.raise_error(F.lit("blank line in the identifier list")).cast("string")
    here = ended.select("file", _limited(F.when(blank, stop).otherwise(last_of_whole(F.col("fresh")))).alias("field"))
    return here.unionByName(_over_lines(lines, told.where(~F.col("whole"))))


def _over_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, field) of last fields that go over several lines, or that the end of a file leaves open.

    ``rows`` are the lines that a field begins in and does not end, and those it goes on in. It is a
    last field if the record ends with it: if its last line closes it, or is the last of the file.
    """
    begins = F.col("fresh").isNotNull()
    place = F.struct("block", *_PLACE)
    parts = stage(
        rows.select(
            *_SPLIT, place.alias("place"), F.when(begins, place).alias("first"),
            F.when(begins, F.regexp_extract("fresh", _OPENED, 1)).otherwise(F.col("line")).alias("text"),
            (~begins & F.rlike("line", F.lit(_CLOSING + r"\z"))).alias("closes"),
        ),
        "csv-parts",
    )
    inside = Window.partitionBy(*_SPLIT).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.groupBy(*_SPLIT).agg(F.max("first").alias("first"))
    carried = begun.select(*_SPLIT, F.last("first", ignorenulls=True).over(earlier).alias("carried"))
    known = parts.withColumn("first", F.last("first", ignorenulls=True).over(inside)).join(carried, _SPLIT)
    known = known.select("file", F.coalesce("first", "carried").alias("first"), "place", "text", "closes")
    total = F.sum("size")
    unended = (total == F.max("file_size") + 1) | (total == F.max("file_size") - 2)
    files = lines.groupBy("file").agg(
        F.max(F.struct("block", *_PLACE)).alias("end"), (unended & ~F.max_by("returned", F.struct("block", *_PLACE))).alias("unended")
    )
    fields = known.groupBy("file", "first").agg(
        F.sum(F.length("text") + 1).alias("chars"), F.max("place").alias("end"), F.max_by("closes", "place").alias("closes")
    )
    last = fields.join(files.select("file", F.col("end").alias("file_end"), "unended"), "file")
    ends_record = F.col("closes") | (F.col("end") == F.col("file_end"))
    # Quotes may be doubled inside a field; a longer text has too long a field in any case. The error names
    # its condition in full, as Spark may evaluate it before the filter.
    too_long = F.raise_error(F.lit(f"field of over {FIELD_LIMIT} characters")).cast("string")
    file = F.when(ends_record & (F.col("chars") > 2 * FIELD_LIMIT + 4), too_long).otherwise(F.col("file"))
    checked = last.where(ends_record).withColumn("file", file)
    gathered = (
        known.drop("closes").join(checked.select("file", "first", "closes", "unended"), ["file", "first"])
        .groupBy("file", "first")
        .agg(F.first("closes").alias("closes"), F.first("unended").alias("unended"), F.sort_array(F.collect_list(F.struct("place", "text"))).alias("parts"))
    )
    text = F.array_join("parts.text", "\n")
    end = F.when(F.col("unended"), "").otherwise("\n")
    opened = F.concat(F.replace(F.substring(text, F.lit(2), F.length(text)), F.lit('""'), F.lit('"')), end)
    return gathered.select("file", _limited(F.when(F.col("closes"), _unquoted(text)).otherwise(opened)).alias("field"))
